"""Near duplicates, repeated strings, common lines and benchmark overlaps against brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veil.llm import decontaminate, line_dedup, ngram_join, repeats
from veil.llm.components import components


def brute_classes(rows, similarity=0.8):
    make = ngram_join.Shingles()
    sets = [set(make.of(t or "").tolist()) for _, t in rows]
    parent, links = list(range(len(rows))), Counter()

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    members = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        members[top(i)].append(key)
    ids = {r: min((k for k in m if k is not None), default=None) for r, m in members.items()}
    return Counter((key, ids[top(i)], links[i]) for i, (key, _) in enumerate(rows))


def near_copies(seed, groups=6, size=9, words=60):
    draw, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{draw.randrange(500)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(draw.randrange(4)):
                own[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize("chunk_chars", [300, 2_000_000])
def test_near_duplicates(spark, docs, edges, chunk_chars):
    rows = near_copies(1) + [(1000 + r["doc_id"], r["text"]) for r in docs.limit(60).collect()] + \
        [(r["doc_id"] and 5000 + r["doc_id"], r["text"]) for r in edges.collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = ngram_join.near_duplicates(df, chunk_chars=chunk_chars).collect()
    assert Counter((r["doc_id"], r["class_id"], r["links"]) for r in got) == brute_classes(rows)


def test_members_of_a_block_are_bounded(spark):
    rows = near_copies(3, groups=3, size=30)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = ngram_join.near_duplicates(df, chunk_members=4).collect()
    assert Counter((r["doc_id"], r["class_id"], r["links"]) for r in got) == brute_classes(rows)
    texts = spark.range(9000).select(F.array(F.lit("h")).alias("hubs"), F.lit("short text").alias("text"))
    sizes = ngram_join._chunks(texts, ngram_join.CHUNK_CHARS, ngram_join.CHUNK_MEMBERS)
    assert [r["chunks"] for r in sizes.collect()] == [5]


def test_one_of_each_class_stays(spark, edges, clashing, nothing):
    kept = ngram_join.keep_one(clashing)
    assert kept.columns == clashing.columns
    rows = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert Counter(r[0] for r in rows) == Counter([1, 2, 4, 5, 6, 7, None])
    assert ngram_join.keep_one(nothing).count() == 0


def test_bands_reach_the_recall():
    for similarity, recall in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.9999)):
        bands, rows = ngram_join.bands_and_rows(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall and bands * rows <= ngram_join.MOST_HASHES


def test_components(spark):
    draw = random.Random(2)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(260)] + [(400 + i, 401 + i) for i in range(60)]
    parent = list(range(500))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: top(x) for p in pairs for x in p if p[0] != p[1]}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def brute_repeats(rows, size=repeats.WINDOW):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for (key, _), b in zip(rows, data, strict=True):
        lost = np.zeros(len(b) + 2, dtype=bool)
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                lost[i + 1:i + 1 + size] = True
        spans = int((lost[1:] & ~lost[:-1]).sum())
        out.append((key, len(b), int(lost.sum()), spans, bytes(c for c, x in zip(b, lost[1:], strict=False) if not x)))
    return Counter(out)


def repeat_rows(seed):
    draw = random.Random(seed)

    def noise(n):
        return "".join(draw.choice("abcdefgh ") for _ in range(n))

    shared = [noise(n) for n in (199, 200, 201, 230, 400, 900)]
    rows = [(i, noise(draw.randrange(300)) + draw.choice(shared) + noise(draw.randrange(300)) + draw.choice(shared)
             [draw.randrange(50):] + noise(draw.randrange(40))) for i in range(40)]
    extra = ["a" * 500, "ab" * 300, "xyz " * 100, "b" * 199, "c" * 200, "d" * 201, None, "", "Ä" * 150, "ü" * 99 + "x"]
    return rows + [(100 + i, t) for i, t in enumerate(extra)] + rows[:3] + [(None, rows[5][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_strings(spark, seed):
    rows = repeat_rows(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = repeats.remove_repeats(df).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == \
        brute_repeats(rows)


def test_repeats_of_odd_tables(clashing, nothing):
    out = repeats.remove_repeats(clashing)
    assert out.columns == [*clashing.columns, "kept_", "n_bytes_", "n_removed", "n_spans"]
    assert out.count() == clashing.count() and repeats.remove_repeats(nothing).count() == 0


def test_patience():
    assert line_dedup.patience(list("abcxdef"), list("abcydef")) == [(0, 0), (1, 1), (2, 2), (4, 4), (5, 5), (6, 6)]
    assert line_dedup.patience(list("xabcq"), list("yyabcz")) == [(1, 2), (2, 3), (3, 4)]
    draw = random.Random(4)
    for _ in range(200):
        a, b = ([draw.choice("abcdefghij") for _ in range(draw.randrange(12))] for _ in "ab")
        found = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x < y and p < q for (x, p), (y, q) in zip(found, found[1:], strict=False))


def line_rows():
    def lines(*numbers):
        return "\n".join(f"This is line number {n} and it is long enough to count as a block." for n in numbers)

    return [
        (1, lines(1, 2, 3)), (2, lines(9, 2, 3, 8)), (3, lines(7, 3, 6)), (4, lines(1, 2, 3)), (5, "short\nshort"),
        (6, "short\nother"), (7, lines(20)), (8, lines(3, 2)), (None, lines(20, 21)), (9, None), (10, ""), (4, lines(1, 2, 3)),
    ]


def test_lines_of_earlier_documents_go(spark):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter((r["doc_id"], r["text"], r["n_deleted"]) for r in line_dedup.delete_common_lines(df).collect())

    def left(n):
        return f"This is line number {n} and it is long enough to count as a block."

    assert got == Counter([
        (1, rows[0][1], 0), (2, left(9) + "\n" + left(8), 2), (3, left(7) + "\n" + left(6), 1), (4, "", 3), (4, "", 3),
        (5, "short\nshort", 0), (6, "short\nother", 0), (7, left(20), 0),
        # Aligning 3, 2 with 1, 2, 3 keeps one of the two.
        (8, left(2), 1) if (8, left(2), 1) in got else (8, left(3), 1),
        (None, left(21), 1), (9, None, 0), (10, "", 0)])


def test_runs_of_many_texts_at_once():
    draw = np.random.default_rng(3)
    texts = [draw.integers(0, 30, draw.integers(0, 12)) for _ in range(200)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = set(zip(*(x.tolist() for x in line_dedup.key_runs(np.concatenate(texts), 40, bounds)), strict=True))
    alone = set()
    for start, sizes in zip(bounds, texts, strict=False):
        for i in range(len(sizes)):
            for j in range(i + 1, len(sizes) + 1):
                inner = min(sizes[i + 1:j].sum(), sizes[i:j - 1].sum())
                shortest = sizes[i:j].sum() >= 40 and (sizes[i] and sizes[i:j - 1].sum() < 40 or sizes[j - 1] and sizes[i + 1:j].sum() < 40)
                if shortest and inner >= 0:
                    alone.add((int(start + i), int(start + j)))
    assert found == alone


@pytest.mark.parametrize("text", ["", "\n", " a \t b\x0b\r\n\x0c\n  ", "é 😀\u00a0x\n x\u2003 "])
def test_lines_of_a_text(text):
    hashes, sizes = line_dedup.text_lines(text)
    bare = [re.sub(r"^[ \t\x0b\x0c\r]+|[ \t\x0b\x0c\r]+$", "", x) for x in text.split("\n")]
    assert sizes == [len(re.sub(r"[ \t\x0b\x0c\r]", "", x)) for x in bare]
    assert [hashes[i] == hashes[0] for i in range(len(bare))] == [x == bare[0] for x in bare]


def test_frequent_lines_go_at_every_size(spark):
    line = "The same frequent line of text stands in all of these documents."
    rows = [(i, f"Own first line of document {i} as it is\n{line}\nOwn last line of document {i}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_deleted"] for r in line_dedup.delete_common_lines(df).collect()}
    assert got == {i: min(i, 1) for i in range(120)}


def brute_lines(rows):
    """Each text against all earlier texts."""
    split = {key: [(x.strip(), len(re.sub(r"\s", "", x))) for x in text.split("\n")] for key, text in rows}
    out = {}
    for key, own in split.items():
        lost = set()
        for other in (o for k, o in split.items() if k < key):
            lost |= set(line_dedup.common_blocks([x for x, _ in other], [x for x, _ in own], [n for _, n in own]))
        out[key] = len({i for i in lost if own[i][1]})
    return out


P1, P2 = "A first line of the passage that stands in the hub twice.", "A second line of the passage that is shared by all of them."


def test_other_partners_than_the_first(spark):
    # The hub holds the passage twice.
    rows = [(0, f"x\n{P1}\n{P2}\ny\n{P1}\n{P2}\nz")] + [(i, f"own {i}\n{P1}\n{P2}\nend {i}") for i in range(1, 5)]
    # Short lines whose runs of two have different hubs.
    a, b, c = "fifteen letters", "and again fifteen", "the last fifteen"
    rows += [(10, f"o\n{a}\n{b}\np"), (11, f"q\n{b}\n{c}\nr"), (12, f"s\n{a}\n{b}\n{c}\nt"), (13, f"u\n{a}\n{b}\n{c}\nv")]
    # The first document has the passages in the other order.
    rows += [(20, f"{P1}!\no20\n{P2}!"), (21, f"o21\n{P1}!\ne21"), (22, f"o22\n{P2}!\ne22"), (23, f"{P2}!\no23\n{P1}!")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["n_deleted"] for r in line_dedup.delete_common_lines(df).collect()}
    assert got == {0: 0} | {i: 2 for i in range(1, 5)} | {10: 0, 11: 0, 12: 0, 13: 3} | {20: 0, 21: 1, 22: 1, 23: 2}


def test_lines_against_all_earlier_documents(spark):
    draw = random.Random(8)
    lines = [f"line {n} " + "abc" * draw.randrange(1, 16) for n in range(12)]
    rows = [(i, "\n".join(draw.choice(lines) for _ in range(draw.randrange(1, 9))) + f"\n{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = {r["doc_id"]: r["n_deleted"] for r in line_dedup.delete_common_lines(df).collect()}
    assert out == brute_lines(rows)


def test_lines_of_odd_tables(clashing, nothing):
    out = line_dedup.delete_common_lines(clashing)
    assert out.columns == [*clashing.columns, "n_deleted_"] and out.count() == clashing.count()
    lost = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] in (1, 8)}
    assert lost[8] == "" and lost[1].startswith("One")
    assert line_dedup.delete_common_lines(nothing).count() == 0


def brute_overlap(tokens, item, least=13, share=0.2):
    """The longest stretch along any alignment that begins and ends with equal words and keeps to the share."""
    best, need = 0, min(least, len(item))
    for shift in range(-len(item) + 1, len(tokens)):
        same = [0 <= shift + j < len(tokens) and tokens[shift + j] == item[j] for j in range(len(item))]
        inside = [j for j in range(len(item)) if 0 <= shift + j < len(tokens)]
        for a in inside:
            for b in inside:
                size = b - a + 1
                if size >= max(need, best + 1) and same[a] and same[b] and \
                        sum(not same[j] for j in range(a, b + 1)) <= share * size + 1e-9:
                    best = size
    return best


def test_overlaps(spark):
    draw = random.Random(5)
    vocabulary = [f"t{i}" for i in range(4000)]
    items = [[draw.choice(vocabulary) for _ in range(n)] for n in (6, 12, 13, 30, 60)]
    rows = []
    for i in range(60):
        words = [draw.choice(vocabulary) for _ in range(50)]
        part = list(items[i % 5])
        for _ in range(i // 10):
            part[draw.randrange(len(part))] = "swapped"
        if i % 7:
            part = part[:draw.randrange(1, len(part) + 1)]
        rows.append((i, " ".join(words[:20] + part + words[20:])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    tests = spark.createDataFrame([(i, " ".join(x).upper() + "!") for i, x in enumerate(items)], "item_id int, text string")
    got = {r["doc_id"]: r for r in decontaminate.mark_contaminated(docs, tests).collect()}
    for key, text in rows:
        tokens = re.findall(r"\w+", text)
        want = [brute_overlap(tokens, x) for x in items]
        seeds = {int(h) for x in items for hs, _ in decontaminate.seeds(decontaminate.Tokens().of(" ".join(x))) for h in hs}
        own = {int(h) for hs, _ in decontaminate.seeds(decontaminate.Tokens().of(text)) for h in hs}
        short = any(f" {' '.join(x)} " in f" {text} " for x in items if len(x) < 10)
        if max(want) and (seeds & own or short):  # an overlap no seed touches is not a candidate
            assert got[key]["n_items"] >= 1 and got[key]["longest"] == max(want), (key, want)
        elif not max(want):
            assert got[key]["n_items"] == 0
    assert sum(r["n_items"] > 0 for r in got.values()) > 15


def test_a_mask_fits_whatever_is_substituted():
    masks = [int(m, 2) for m in decontaminate.MASKS]
    for size in range(10, 26):
        # A shorter item counts whole, so that it begins and ends with equal words.
        free = range(size) if size >= decontaminate.LEAST_TOKENS else range(1, size - 1)
        for places in itertools.combinations(free, size // 5):
            swapped = sum(1 << p for p in places)
            assert any(not swapped & m << at for m in masks for at in range(size - m.bit_length() + 1)), (size, places)


def test_all_overlaps_are_found(spark):
    draw = random.Random(9)
    vocabulary = [f"t{i}" for i in range(4000)]
    items = [[draw.choice(vocabulary) for _ in range(n)] for n in (10, 11, 12, 13, 15, 20, 40, 200)]
    rows = []
    for i in range(120):
        words, part = [draw.choice(vocabulary) for _ in range(30)], list(items[i % 8])
        every = range(2, len(part) - 1, 5) if i < 8 else draw.sample(range(1, len(part) - 1), len(part) // 5)
        for at in every:
            part[at] = "swapped"
        rows.append((i, " ".join(words[:15] + part + words[15:])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    tests = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id int, text string")
    got = {r["doc_id"]: (r["n_items"], r["longest"]) for r in decontaminate.mark_contaminated(docs, tests).collect()}
    for key, text in rows:
        assert got[key] == (1, brute_overlap(text.split(), items[key % 8])), key


def test_short_items_may_have_a_word_changed(spark):
    items = [[f"s{n}w{k}" for k in range(n)] for n in range(1, 10)]
    rows = [(100 * len(x) + at, " ".join(["before", *x[:at], "swapped", *x[at + 1:], "behind"]))
            for x in items for at in range(1, len(x) - 1)]
    rows += [(100 * len(x), " ".join(["before", *x, "behind"])) for x in items]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    tests = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id int, text string")
    got = {r["doc_id"]: (r["n_items"], r["longest"]) for r in decontaminate.mark_contaminated(docs, tests).collect()}
    assert got == {key: (1, key // 100) if key % 100 == 0 or key >= 500 else (0, 0) for key, _ in rows}


def test_overlap_by_brute_force():
    draw = np.random.default_rng(6)
    for _ in range(300):
        a, b = draw.integers(0, 2, 40), np.ones(40, dtype=int)
        a[draw.random(40) < 0.5] = 1
        same, best = a == b, 0
        for i in range(40):
            for j in range(i, 40):
                if same[i] and same[j] and (~same[i:j + 1]).sum() <= 0.2 * (j - i + 1) + 1e-9:
                    best = max(best, j - i + 1)
        assert decontaminate.overlap(a, b, 13, 0.2) == (best if best >= 13 else 0)


def test_overlaps_of_odd_tables(spark, edges, clashing, nothing):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "no id at all but some words")], "item_id int, text string")
    out = decontaminate.mark_contaminated(clashing, items)
    assert out.columns == [*clashing.columns, "n_items_", "longest"]
    assert {r["doc_id"] for r in out.filter("n_items_ > 0").collect()} == {None}
    assert decontaminate.mark_contaminated(nothing, items).count() == 0
    assert decontaminate.mark_contaminated(edges, items.limit(0)).filter("n_items > 0").count() == 0
