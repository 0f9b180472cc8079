"""Main text, conversation repair and collocations against plain versions of the same rules."""

import hashlib
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from veil.llm.collocations import collocations
from veil.llm.conversation_repair import Automaton, message_digests, repair_conversations
from veil.llm.main_text import extract, main_text
from veil.llm.queries import QUERIES

WHITE = " \t\n\x0b\x0c\r"


# conversations

def brute_repair(rows):
    """All of a conversation's figures by a table over message and state, audits as whole strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen
                      else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    wants = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {}
    for i in range(len(rows), -1, -1):
        options = {q: [(0, "", ())] if i == len(rows) and q in ("", "a") else [] for q in wants}
        for q, want in wants.items():
            if i < len(rows):
                _, role, text = rows[i]
                c, a, m = best[i + 1, q]
                options[q].append((c + 2, "D" + a, m))
                if faults[i] not in ("blank", "duplicate"):
                    extra = 5 * (faults[i] == "truncated")
                    if role[:1] == want or (role[:1] == "s" and q == ""):
                        c, a, m = best[i + 1, role[:1]]
                        options[q].append((c + extra, "K" + a, (f"{role}:{text}", *m)))
                    c, a, m = best[i + 1, want]
                    name = {"u": "user", "a": "assistant"}[want]
                    options[q].append((c + extra + 1, "R" + a, (f"{name}:{text}", *m)))
        for _ in range(4):
            for q, want in wants.items():
                name = {"u": "user", "a": "assistant"}[want]
                for c, a, m in list(options[want]):
                    options[q].append((c + 5, "I" + a, (f"{name}:", *m)))
            options = {q: [min(o)] if o else [] for q, o in options.items()}
        best.update({(i, q): o[0] for q, o in options.items()})
    cost, audit, messages = best[0, ""]
    turns = {r[0] for r in rows if r[0] is not None}
    initials = [r[1][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(messages).encode()).hexdigest(),
    }


def repaired_rows(rows):
    report, repaired = repair_conversations(rows)
    names = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    digests = {r["conv_id"]: r["repaired_sha256"] for r in message_digests(repaired).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r["conv_id"]: {n: r[n] for n in names[1:]} | {"repaired_sha256": digests.get(r["conv_id"], empty)}
            for r in report.collect()}


def brute_all(rows):
    grouped = {}
    for c, turn, role, text in rows:
        grouped.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: brute_repair(r) for c, r in grouped.items()}


def random_conversations(seed, n):
    rng = random.Random(seed)
    texts = ["Fine.", "Fine.", "Cut off", "", " \t", "Why?", "No! ", "Ümlaut 😀.", None, "a.\x0b", "Other."]
    rows = []
    for c in range(n):
        for _ in range(rng.choice([1, 2, 3, 5, 8, 13])):
            rows.append((None if c == 3 else c, rng.choice([None, *range(9)]),
                         rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None, "usher"]),
                         rng.choice(texts)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def test_repair_is_the_cheapest(spark):
    rows = random_conversations(5, 250)
    found = repaired_rows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
                          .repartition(5).withColumn("c", F.lit("9")).withColumn("audit", F.lit("x")))
    assert found == brute_all(rows)


def test_repair_of_a_long_conversation(spark):
    rng = random.Random(1)
    rows = [(7, i // 2, rng.choice(["user", "assistant", "x"]), rng.choice(["A.", f"B{i}.", f"C{i}", ""]))
            for i in range(900)]
    rows += [(c, t, r, "Same.") for c in range(100, 160) for t, r in enumerate(["user", "assistant", "user"])]
    found = repaired_rows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert found == brute_all(rows)


def test_repair_of_nothing(spark):
    report, repaired = repair_conversations(
        spark.createDataFrame([], "conv_id string, turn int, role string, text string"))
    assert report.count() == repaired.count() == message_digests(repaired).count() == 0


def test_endings_are_solved_once():
    automaton = Automaton()
    signatures = sorted(("".join(random.Random(i).choices("AEI", k=6)) for i in range(300)), key=lambda s: s[::-1])
    for s in signatures:
        automaton.enter(s)
    assert automaton.nodes == len({s[i:] for s in signatures for i in range(7)})


def test_repair_query(spark):
    folder = "/root/testdata/sf0.001"
    kept = []
    source = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    for c, turn, role, text in source:
        damage = zlib.crc32(f"{c}:{turn}".encode()) % 20
        text = "" if damage == 1 else "".join(x for x in text if x not in ".!?") if damage == 2 else text
        kept += [(c, turn, "user" if damage == 4 else role, text)] * (damage != 0) * (1 + (damage == 3))
    wanted = brute_all(kept)
    found = {r["conv_id"]: r.asDict() for r in QUERIES["op12_conversation_repair"](spark, folder).collect()}
    assert set(found) == {r[0] for r in source}
    for c, r in found.items():
        nothing = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
                   "repaired_sha256": hashlib.sha256(b"").hexdigest()}
        assert {k: v for k, v in r.items() if k != "conv_id"} == wanted.get(c, nothing)


# collocations

def brute_collocations(rows, least, top, share):
    import re

    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i:i + size])] += 1
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = {}
    for (lang, words), a in found.items():
        if any(other == lang and len(longer) > len(words) and 100 * b >= share * a and any(
                longer[i:i + len(words)] == words for i in range(len(longer))) for (other, longer), b in found.items()):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k, f[lang, words[:k]],
                              f[lang, words[k:]]) for k in range(1, len(words)))
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), l, r))
    return {(lang, i + 1): (p.decode(), -a, l, r, n[lang], -score) for lang, rows in out.items()
            for i, (score, a, p, l, r) in enumerate(sorted(rows)[:top])}


def test_collocations(spark):
    rng = random.Random(3)
    words = ["the", "New", "york", "é", "times", "a", "-", "\x00", "München", "x y"]
    rows = [(" ".join(rng.choices(words, k=rng.choice([0, 1, 4, 40]))) + rng.choice([". New York times!", "", "\t\n\x0b the the the the the"]),
             rng.choice(["en", "de", None, "und", ""])) for _ in range(400)]
    rows += [(None, None), ("", "en"), ("a b c d e " * 5000, "long"), ("x" * 9000, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    docs = docs.withColumn("w1", F.lit("9")).withColumn("a.b", F.lit(1)).withColumn("rank", F.lit(1))
    for least, top, share, bits in ((30, 2000, 80, 26), (5, 7, 100, 4), (3, 50, 30, 12)):
        found = {(r["lang"], r["rank"]): (r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"])
                 for r in collocations(docs, least=least, top=top, share=share, cell_bits=bits).collect()}
        assert found == brute_collocations(rows, least, top, share)


def test_collocations_of_nothing(spark, nothing):
    assert collocations(nothing.withColumn("lang", F.lit("en"))).count() == 0


# main text

PROSE = ("This is a long enough paragraph that has the words one would see in a text of this kind, and so it is "
         "content number {}.")
NOISE = [
    "<nav><ul><li><a href='/'>Home</a></li><li><a href=/b>Contact us</a></ul></nav>",
    "<header><p>" + PROSE.format("h") + "</p></header>", "<footer>&copy; 2020 Someone</footer>",
    "<aside><p>" + PROSE.format("aside") + "</aside>", "<div class='cookie-notice'>" + PROSE.format("cookie") + "</div>",
    "<div id=adBanner><p>" + PROSE.format("ad") + "</p></div>", "<script>var a = '</p><p>' + 1 < 2;</script>",
    "<form action=/><label>Name</label><input name=a><select><option>one</select><button>Send</button></form>",
    "<section class='Comments list'><article><p>" + PROSE.format("comment") + "</p></article></section>",
    "<style>p > a {color: red}</style>", "<!-- <p>" + PROSE.format("hidden") + "</p> -->",
    "<div role=complementary><p>" + PROSE.format("side") + "</div>", "<noscript>Please enable scripts</noscript>",
    "<p style='display: none'>" + PROSE.format("unseen") + "</p>",
]


@pytest.mark.parametrize("marked", ["article", "main", "none"])
def test_main_text_of_made_pages(marked):
    rng = random.Random(marked)
    for _ in range(150):
        blocks, wanted = [], []
        for i in range(rng.randint(2, 6)):
            if rng.random() < 0.5:
                blocks.append(rng.choice(NOISE))
            prose = PROSE.format(i)
            if rng.random() < 0.4:
                blocks.append(f"<h2>Heading {i} &amp; more</h2>")
                wanted.append(f"Heading {i} & more")
            blocks.append(f"<p>{prose.replace('enough', '<b>enough</b>')}" + rng.choice(["</p>", "", "<br>", "\n</P >"]))
            wanted.append(prose)
        tag = {"article": "article", "main": "main", "none": "div"}[marked]
        around = rng.sample(NOISE, 3)
        page = (f"<!DOCTYPE html><html><head><title>T</title></head><body class=has-sidebar>{around[0]}<{tag}>"
                f"{''.join(blocks)}</{tag}>{around[1]}{around[2]}</body>")
        assert extract(page) == "\n".join(wanted), page


def test_blocks_with_few_stop_words_follow_their_neighbours():
    prose, names = PROSE.format(1), "Anton Berta Caesar Dora Emil Friedrich Gustav Heinrich Ida Julius and Konrad of Ludwig " * 3
    assert extract(f"<div>{prose}</div><div>{names}</div><div>{prose}</div>") == f"{prose}\n{names.strip()}\n{prose}"
    links = "<div><a href=1>one link</a> <a href=2>another link</a></div>"
    assert extract(f"{links}<div>{names}</div>{links}<div>{prose}</div>{links}") == prose


@pytest.mark.parametrize("page, wanted", [
    ("", ""), ("   ", ""), ("<p>", ""), ("<article>", ""), ("<article><p>a &lt;b&gt;&nbsp;c &am; &#228;</article>", "a <b> c &am; ä"),
    ("<article><h1>Only a title</h1></article><footer>x</footer>", "Only a title"),
    ("<article>one<br>two<hr>three <em>f</em>our</article>", "one two\nthree four"),
    ("<article><p>cut <b>off</b> in a tag <a hre", "cut off in a tag"),
    ("<article><p class=ad>Buy<p>Keep</article>", "Keep"),
    ("<article><p>a <span class=ad>buy</span> b</p></article>", "a b"),
    ("<article><header><h1>Title</h1><p>by me</p></header><p>Text</article>", "Title\nText"),
    ("<ARTICLE><P>1 < 2 and 3 > 2</P></ARTICLE>", "1 < 2 and 3 > 2"),
    ("<article><textarea><p>no</p></textarea><p>yes</p></article>", "yes"),
    ("<form id=aspnet><article><p>whole page in a form</p></article></form>", "whole page in a form"),
    ("<div><a href=1>all</a> <a href=2>links</a></div>", ""), ("</p></div></article>", ""),
])
def test_main_text_of_odd_pages(page, wanted):
    assert extract(page) == wanted


def test_main_text_table(spark, clashing, nothing):
    rows = clashing.withColumnRenamed("text", "html").withColumn("text", F.lit("mine"))
    out = main_text(rows).collect()
    assert main_text(rows).columns == [*rows.columns, "text_"] and len(out) == rows.count()
    for r in out:
        page = SimpleNamespace(**{"html": r["html"] or "", "text": r["text_"]})
        assert page.text == extract(page.html) and r["text"] == "mine" and r["a.b"] == "9"
    assert main_text(nothing, html="text", out="main").count() == 0
