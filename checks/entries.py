"""What the comparison SQL expects generated and substituted values to be drawn from."""

PEOPLE = [
    "Tamsin Okafor", "Ruben Castellano", "Ingrid Halvorsen", "Mateus Pereira", "Yuki Tanabe", "Noor Haddad",
    "Lorcan Byrne", "Zofia Nowicka", "Amadou Keita", "Petra Novotna", "Silvio Marchetti", "Hanna Virtanen",
    "Dilan Aydin", "Odette Lemaire", "Kofi Asante",
]
CLIENTS = [
    "Marisol Vega", "Tobias Lindqvist", "Priya Raman", "Emeka Obi", "Clara Fontaine", "Jonas Weiland",
    "Sunniva Dahl", "Rafael Moura", "Leila Nasser", "Viktor Horak",
]
FIRMS = [
    "Larkspur Foods", "Tidewater Optics", "Copperleaf Energy", "Northgate Textiles", "Bluestem Logistics",
    "Quartzite Media", "Harborline Tools", "Fernhill Robotics",
]
DEPARTMENTS = [
    "Research", "Logistics", "Legal", "Procurement", "Support", "Design",
]
CITIES = [
    "Boise", "Duluth", "Tucson", "Savannah", "Eugene", "Dayton", "Laramie", "Mobile", "Wichita", "Burlington",
]
STATES = [
    "ID", "MN", "AZ", "GA", "OR", "OH", "WY", "AL", "KS", "VT",
]
MANAGERS = [
    "Beatriz Colman", "Anders Friis", "Wanjiru Kamau", "Gideon Marsh",
]
STREETS = [
    "Juniper", "Quarry", "Lantern", "Millrace", "Harrow",
]
TRANSACTION_TYPES = [
    "Sale", "Return", "Deposit", "Withdrawal",
]
MERCHANTS = [
    "Cedar Market", "Volt and Wire", "Page Turner Books", "Kettle and Crumb", "Trailhead Outfitters",
]
CATEGORIES = [
    "Books", "Hardware", "Food", "Sports", "Transport",
]
PAYMENTS = [
    "Card", "Cash", "Invoice", "Voucher",
]
LOCATIONS = [
    "Boise, ID", "Tucson, AZ", "Eugene, OR", "Savannah, GA",
]

SUBSTITUTES = {
    "names": [
        "Avery Sandoval", "Bram Kuipers", "Celeste Moreau", "Darya Melnik", "Esteban Rojas", "Farah Aziz",
        "Gustav Ekman", "Hollis Grant", "Imani Njoroge", "Jasper Whitlock",
    ],
    "companies": [
        "Aspen Ridge Partners", "Bramble Works", "Cobalt Harbor", "Driftwood Foods", "Evergreen Circuits",
        "Foxglove Media", "Granite Peak", "Hollow Reed Design", "Ironwood Freight", "Juniper Analytics",
    ],
    "cities": [
        "Aldermoor", "Brackwater", "Cinderford", "Dunhollow", "Eastmere", "Fallowby", "Glenharrow", "Highbeck",
        "Islewick", "Kestrelton",
    ],
    "domains": [
        "mail.invalid", "post.invalid", "box.invalid", "inbox.example", "letters.example", "notes.example",
        "relay.test", "courier.test",
    ],
    "countries": [
        "Arvenia", "Calder Isles", "Drovinia", "Elmarra", "Gharia",
    ],
}
