"""Each operator against brute force on small tables, and on awkward rows."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, exact_dedup, html_text, jaccard_join, lm_trie, mixing, quality, suffix_dedup, toxicity, url_filter
from lodestone.llm.elias_fano import EliasFano
from lodestone.llm.queries import fold
from lodestone.llm.text import U64, Words, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def table(spark, rows, lang="en"):
    """Documents with extra columns whose names operators use inside."""
    d = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in rows], SCHEMA)
    return d.withColumns({c: F.lit("x") for c in ("__id", "rep", "score", "rate", "window", "digest", "keep", "label", "node", "component")})


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


LONG = prose(60_000, 5)
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, LONG), (7, LONG.upper()), (8, prose(60, 1)), (8, prose(60, 1)), (9, prose(60, 1) + " x"), (None, prose(60, 1)), (None, None), (10, " 　É ß 語"), (11, "\x00 a \x00")]


@pytest.fixture(scope="module")
def small(spark, data):
    d = spark.read.parquet(f"{data}/sf0.001/documents.parquet")
    return d, {r.doc_id: r.text for r in d.collect()}


# --- shared parts


def test_shingles_equal_brute_force():
    texts = ["", "a", "A b", "a b c d", "a b c d a b c d e", "é  B\tc\n", prose(500), " x " * 40]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    w = Words(data, off)
    h, first = shingle_sets(w, 4)
    names = {}
    for i, t in enumerate(texts):
        v = WORD.findall(low(t))
        s = {tuple(v[j : j + 4]) for j in range(len(v) - 3)} if len(v) >= 4 else {tuple(v)} if v else set()
        assert len(s) == first[i + 1] - first[i]
        for x in h[first[i] : first[i + 1]].tolist():
            names.setdefault(x, []).append(i)
    assert len(h) == first[-1]


@pytest.mark.parametrize("bits,n", [(64, 0), (64, 1), (64, 1000), (40, 5000), (12, 3000), (1, 50), (20, 100_000)])
def test_elias_fano(bits, n):
    r = np.random.default_rng(bits + n)
    v = np.sort(r.integers(0, 1 << min(bits, 63), n, dtype=np.int64).astype(U64))
    e = EliasFano.build(v, bits)
    if n:
        assert (e.access(np.arange(n)) == v).all()
    q = np.concatenate([v[:500], r.integers(0, 1 << min(bits, 63), 500).astype(U64), np.array([0], U64)])
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), n)
    assert ((e.within(q, lo, hi) >= 0) == np.isin(q, v)).all() and (e.within(q, hi, hi) == -1).all()
    assert (e.successor(q) == np.searchsorted(v, q, "left")).all()
    assert ((e.find(q) >= 0) == np.isin(q, v)).all()


# --- 1


def brute_groups(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    index, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for x in s:
            index[x].append(i)
    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in index[x] if j < i).items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return sorted((i, len(s), root(i)) for i, s in sets.items())


def edited(seed):
    """Families of texts at similarities around the threshold, many with a common line."""
    r = random.Random(seed)
    rows, line = [], prose(9, 99)
    for f in range(25):
        base = prose(r.choice([3, 6, 12, 30, 80, 200]), f).split()
        for _ in range(r.choice([1, 2, 6, 30])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice("pqrstuv")
            rows.append((" ".join(w) + (" " + line if f % 3 else "")))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("n,num,seed", [(4, 85, 1), (5, 80, 2), (3, 60, 3)])
def test_jaccard_equals_brute_force(spark, n, num, seed):
    rows = edited(seed)
    got = jaccard_join.similar_groups(table(spark, rows).repartition(3), n, num, 100)
    assert sorted(map(tuple, got.collect())) == brute_groups(rows, n, num, 100)


def test_blocks_lose_no_similar_pair():
    """Whatever the sizes, a pair at the threshold shares a key."""
    r = np.random.default_rng(3)
    for size in [*range(6, 60), 100, 333, 1000]:
        both = r.integers(0, 1 << 63, size, dtype=np.int64).astype(U64)
        gone = (15 * 2 * size) // 185
        for out in range(0, gone + 1, max(1, gone // 3)):
            new = r.integers(0, 1 << 63, max(0, gone - out), dtype=np.int64).astype(U64)
            other = np.concatenate([both[out:], new])
            common = size - out
            if 100 * common < 85 * (size + len(other) - common):
                continue
            h = np.concatenate([np.sort(both), np.sort(other)])
            keys, docs = jaccard_join.block_keys(h, np.array([0, size, size + len(other)]), 85, 100)
            assert set(keys[docs == 0].tolist()) & set(keys[docs == 1].tolist()), (size, out)


def test_jaccard_awkward_rows(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(table(spark, AWKWARD), 4, 85, 100).collect()}
    by = {d: (n, c) for d, n, c in got if d}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[3] == (0, 3) and by[4] == (1, 4) and by[5] == (1, 4)
    assert by[7][1] == 6 and by[8][1] == by[9][1] == 8
    assert (None, 57, None) in got and (None, 0, None) in got
    assert jaccard_join.similar_groups(table(spark, [])).count() == 0
    d = table(spark, AWKWARD)
    assert jaccard_join.keep_one(d).columns == d.columns


def near_threshold(n, seed=0):
    """Texts with 56 common words and 7 of their own: close to a link, but none."""
    common = prose(56, 900).split()
    r = random.Random(seed)
    return [(i, " ".join(common + ["".join(r.choice("klmnopq") for _ in range(9)) for _ in range(7)])) for i in range(n)]


def test_jaccard_rows_grow_with_members(spark):
    """What a group's comparison yields is linear in its members, and without links nothing."""
    from lodestone.llm.text import shingle_sets as ss

    sizes = []
    for m in (200, 400, 800):
        texts = [t for _, t in near_threshold(m)]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        off = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
        h, first = ss(Words(data, off), 5)
        sets = [h[first[i] : first[i + 1]] for i in range(m)]
        x = {"doc": np.arange(m), "comp": np.arange(m), "n": np.diff(first), "side": np.zeros(m, int)}
        assert jaccard_join.spanning(80, 100, (1, 0, 0), x, sets) == []
        links = jaccard_join.spanning(70, 100, (1, 0, 0), x, sets)
        assert len(links) == m - 1
        bits = [np.frombuffer(jaccard_join.dense(s, np.array([0, len(s)])), U64) for s in sets]
        batch = __import__("pyarrow").RecordBatch.from_pydict({"gid": [1] * m, "i": [0] * m, "j": [0] * m, "doc": list(range(m)), "comp": list(range(m)), "n": np.diff(first).tolist(), "side": [0] * m, "bits": [b.tobytes() for b in bits]})
        sizes.append(sum(b.num_rows for b in jaccard_join._near_members(80, 100)(iter([batch]))))
    assert all(n <= m for n, m in zip(sizes, (200, 400, 800), strict=True))


def test_jaccard_hot_block_is_split(spark, monkeypatch):
    """Entries of a block that a slice holds often are one, and large clusters are cut
    into blocks; results stay."""
    rows = edited(7) + [(1000 + i, t) for i, t in near_threshold(60)]
    want = brute_groups(rows, 5, 80, 100)
    for hot, block in ((2, 4096), (10**9, 7)):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = jaccard_join.similar_groups(table(spark, rows).repartition(2), 5, 80, 100, hot=hot)
        assert sorted(map(tuple, got.collect())) == want


def test_jaccard_ids_that_repeat_with_other_texts(spark):
    """Rows link, whatever the partitioning; a group's label is its least id."""
    a, b = prose(40, 801), prose(40, 802)
    rows = [(1, a), (2, a), (2, b), (3, b), (2, None)]
    for parts in (1, 2, 5):
        got = jaccard_join.similar_groups(table(spark, rows).repartition(parts, "text"), 5, 80, 100)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == [(1, 36, 1), (2, 0, 2), (2, 36, 1), (2, 36, 2), (3, 36, 2)]
        kept = jaccard_join.keep_one(table(spark, rows).repartition(parts, "text"))
        assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted([(1, a), (2, b), (2, "")])


def test_functions_travel_without_the_package(tmp_path):
    """Executors need no copy of the package: what op1 sends is pickled by value."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    import lodestone.llm  # noqa: F401

    jaccard_join.bands(85, 100, 1000)
    body = cloudpickle.dumps(jaccard_join._sketches(4, 85, 100, 3, 8))
    (tmp_path / "f").write_bytes(body)
    code = f"""
import pickle, pyarrow as pa
f = pickle.load(open({str(tmp_path / "f")!r}, "rb"))
b = pa.RecordBatch.from_pydict({{"row": [1, 2], "doc_id": [1, 2], "text": ["a b c d e f"] * 2}})
print(sum(x.num_rows for x in f(iter([b]))))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout) > 1, out.stderr[-500:]


# --- 2


def test_main_text(spark):
    field = html_text.trained()
    right = total = 0
    for page, main in html_text.labelled_pages(150, seed=77):
        b = html_text.blocks(page)
        right += sum(x == (i in main) for i, x in enumerate(field.decode(b)))
        total += len(b)
    assert right / total > 0.98
    page = "<body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class=ad>Buy now.</div><article><h1>A &amp; B</h1><p>One  two<br>three &lt;x&gt; 3 < 4.</p><p>Second paragraph, with <b>bold</b> text.</article><section class=comments><p>Nice article!</p></section><footer>&copy; x</footer>"
    assert html_text.main_text(page, field) == "A & B\nOne two three <x> 3 < 4.\nSecond paragraph, with bold text."


def test_pages_of_the_table(spark, data):
    p = spark.read.parquet(f"{data}/sf0.001/pages.parquet")
    want = {}
    for r in p.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want[r.page_id] = "\n".join(x for x in parts if x)
    got = html_text.extract(p).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_broken_pages(spark):
    pages = [None, "", "<", "<p", "<p>x", "</p></div>", "<script>", "<!--", "<a href='x", "a<b<c", "<p>" * 3000 + "x", "<title>t", "<svg/><p>y</p>", "&amp" * 9, "x" * 500_000, "<article><p>" + "word " * 200_000]
    d = spark.createDataFrame([(i, "u", h, "clash") for i, h in enumerate(pages)] + [(None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_text.extract(d).collect()
    assert len(got) == len(pages) + 1 and all(r.text is not None for r in got)
    assert got[0].text == got[1].text == "" and max(r.n_chars for r in got) > 900_000
    assert html_text.extract(d.limit(0)).count() == 0


HOSTILE = ["<a ", '<a b="', "<div>x", '<a "> "', "<b><p>", "<x", "<div></y>", "&lt<i>;", "<td><li>x", "<!-", "<a href='x\">"]


@pytest.mark.parametrize("unit", HOSTILE)
def test_page_time_is_linear(unit):
    import time

    field = html_text.trained()
    times = []
    for page in (unit * (1_000_000 // len(unit)), unit * (1_000_000 // len(unit)) + ">"):
        start = time.process_time()
        html_text.main_text(page, field)
        times.append(time.process_time() - start)
    assert max(times) < 6, times  # a quarter of a million nested blocks take a few seconds


def test_references_are_decoded_in_each_piece():
    b = html_text.blocks("<p>&<b>amp;</b> x &lt<i>;</i> &amp;lt; &copy;</p>")
    assert [x.text for x in b] == ["&amp; x <; &lt; ©"]


def test_field_equals_enumeration():
    """Viterbi and the gradient's normaliser against all labellings of short chains."""
    import itertools

    r = np.random.default_rng(5)
    names = {f: i for i, f in enumerate(["bias", "tag=p", "tag=h1", "links=none", "end=stop", "end=other", "words=1", "words=2", "place=first", "place=last"])}
    for _ in range(30):
        field = html_text.Field(names, r.normal(size=(len(names), 2)), r.normal(size=(2, 2)))
        b = html_text.blocks("".join(r.choice(["<p>One two.</p>", "<h1>One</h1>", "<p>x</p>", "<p>Well.</p>"], r.integers(1, 8))))
        f = html_text.features(b)
        value = lambda y: sum(field.weights[names[x], k] for k, row in zip(y, f, strict=True) for x in row if x in names) + sum(field.moves[i, j] for i, j in zip(y, y[1:], strict=False))  # noqa: B023, E731
        best = max(value(y) for y in itertools.product((0, 1), repeat=len(b)))
        assert abs(value([int(x) for x in field.decode(b)]) - best) < 1e-9


# Layouts that the composer does not make: (html, main text).
LAYOUTS = [
    ("<body><table><tr><td><a href=/>Home</a> <a href=/n>News</a></td></tr><tr><td><p>The council met on Monday and agreed on the plan for the new road.</p><p>Work will begin in the spring, the mayor said after the vote.</p></td></tr></table>", 2),
    ("<main id=content><section><h2>Tea</h2><p>Tea is made from the leaves of a shrub that grows in warm countries.</p></section><section><p>It is drunk hot or cold, with milk or without.</p></section></main><footer><p>Copyright 2020 Tea House</p></footer>", 3),
    ("<div id=wrapper><div class=top-menu><a href=1>One</a><a href=2>Two</a></div><div class=post><h1>A walk</h1><div>We left early and walked along the river until noon.</div><div>Then the rain came, and we went home by bus.</div></div></div>", 3),
    ("<article><h1>Title here</h1><p>First paragraph of the story, long enough to read.</p><ol><li>Boil the water for ten minutes.</li><li>Add the salt and stir it well.</li></ol></article><aside class=related><a href=x>More stories</a></aside>", 4),
    ("<body><div role=navigation><ul><li><a href=a>Start</a><li><a href=b>Contact</a></ul></div><div role=main><p>Birds fly south when the days grow short and the nights are cold.</p></div><div role=contentinfo>&copy; 2021</div>", 1),
    ("<div class=cookie-banner><div><div><span>We use cookies to make this site work.</span> <button>OK</button></div></div></div><article><p>The old bridge was closed to all traffic last week.</p><p>Engineers found cracks in two of its pillars.</p></article>", 2),
    ("<article><h2>Bread</h2><dl><dt>Flour</dt><dd>Five hundred grams of it, sifted twice.</dd></dl><p>Knead the dough until it is smooth.</p></article><section class=comments><div><div><div><div><div><div><div><p>Great recipe, thank you!</p></div></div></div></div></div></div></div></section>", 4),
    ("<main><article><header><h1>Storm</h1></header><p>A storm crossed the coast during the night and took some roofs.</p><blockquote>We have never seen such a wind here.</blockquote></article></main><div class=newsletter><p>Subscribe to our newsletter.</p></div>", 3),
    ("<header><div><a href=/>Site name</a></div><nav><a href=/1>A</a><a href=/2>B</a></nav></header><div class=entry-content><p>Cats sleep for most of the day.</p><h3>Why they do</h3><p>They hunt at dusk and at dawn, which costs much strength.</p></div>", 3),
    ("<div class=story><p>One sentence stands here. Another one follows it.</p><div class=advert><p>Buy two, pay one.</p></div><p>The story goes on after the advert as if nothing had been there.</p></div><div class=sidebar><ul><li><a href=q>Popular</a></li></ul></div>", 2),
]


def test_layouts_of_others():
    """At least nine blocks of ten are right on layouts that no training page has."""
    field, right, total, main = html_text.trained(), 0, 0, 0
    for page, n in LAYOUTS:
        b = html_text.blocks(page)
        y = field.decode(b)
        full = {i for i, x in enumerate(b) if len(x.text.split()) > 3 or x.text in ("Tea", "A walk", "Title here", "Bread", "Flour", "Storm", "Why they do")}
        junk = ("copyright", "©", "home", "cookies", "newsletter", "great recipe", "buy two", "more stories", "site name")
        want = {i for i in full if not any(j in b[i].text.lower() for j in junk) or "went home" in b[i].text}
        assert len(want) == n, [b[i].text for i in want]
        right += sum(bool(v) == (i in want) for i, v in enumerate(y))
        total += len(b)
        main += sum(bool(y[i]) for i in want)
    assert right / total >= 0.9 and main / sum(n for _, n in LAYOUTS) >= 0.85, (right, total, main)


# --- 3

ITEMS = [
    (1, "A train leaves the old station at 9 in the morning and Tom sees 40 people who wait there with 9 heavy bags."),
    (2, prose(30, 301)),
    (3, prose(6, 302)),
    (4, None),
    (5, ""),
]


def test_templates(spark):
    rows = [
        (1, prose(50, 1) + " " + ITEMS[0][1] + " " + prose(50, 2)),
        (2, "Well. " + ITEMS[0][1].replace("9", "7").replace("Tom", "Anna").replace("40", "55")),  # renamed throughout
        (3, "Well. " + ITEMS[0][1].replace("9", "7", 1).replace("Tom", "Anna")),  # two values for one number
        (4, prose(200, 3)),
        (5, ITEMS[1][1].upper() + "\n" + ITEMS[2][1]),
        (6, " ".join(ITEMS[1][1].split()[:4])),
        *[(i + 10, t) for i, t in AWKWARD if i],
    ]
    b = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("slots", F.lit(1))
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(table(spark, rows), b).collect()}
    assert got == {(1, 1): False, (2, 1): True, (5, 2): False, (5, 3): False}
    kept = decontaminate.decontaminate(table(spark, rows), b)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {1, 2, 5} and kept.columns == table(spark, rows).columns
    assert decontaminate.contaminated(table(spark, []), b).count() == 0
    assert decontaminate.contaminated(table(spark, rows), b.limit(0)).count() == 0


def test_one_clash_drops_only_its_windows(spark):
    item = "At 9 the clerk opens the door. " + prose(30, 401) + " and at 9 the clerk shuts it."
    short = ITEMS[0][1]
    rows = [
        (1, item.replace("9", "7", 1)),  # one of two equal numbers edited
        (2, item.replace("9", "7", 1).replace("9", "8")),  # equal by chance, now different
        (3, "Well. " + short.replace("9", "7", 1)),  # the windows of the other 9 are the item's own
        (4, prose(60, 402)),
    ]
    b = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.contaminated(table(spark, rows), b).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2)}


def test_verbatim_copies_of_numbers_and_names(spark):
    items = [
        (1, "What is 12 + 7 * 3 - 4"),
        (2, " ".join(str(17 * i) for i in range(30))),
        (3, "Ask Anna Smith Bob Jones Carl Brown Dora White Emil Black Fred Green"),
        (4, prose(9, 501) + " 1 2 3 4 5 6 7 8 9 10 " + prose(9, 502)),
    ]
    rows = [(i, f"{prose(20, 510 + i)} {t} {prose(20, 520 + i)}") for i, t in items]
    rows += [(11, rows[0][1].replace("12", "13")), (12, " ".join(str(19 * i + 1) for i in range(30))), (14, prose(9, 501) + " 8 8 8 8 8 8 8 8 8 8 " + prose(9, 502))]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(table(spark, rows), b).collect()}
    assert {k for k in got if k[0] < 10} == {(i, i) for i, _ in items} and not {11, 12} & {d for d, _ in got}
    assert all(got[i, i].n_windows >= got[i, i].item_windows - 1 and not got[i, i].reparameterised for i, _ in items)


# --- 4


def brute_spans(rows, least):
    words = [(i, WORD.findall(low(t))) for i, t in rows]
    seen = Counter(tuple(w[j : j + least]) for _, w in words for j in range(len(w) - least + 1))
    out = set()
    for i, w in words:
        span = None
        for j in [j for j in range(len(w) - least + 1) if seen[tuple(w[j : j + least])] > 1]:
            if span and j <= span[1]:
                span = (span[0], j + least)
            else:
                if span:
                    out.add((i, *span))
                span = (j, j + least)
        if span:
            out.add((i, *span))
    return out


def test_passages_equal_brute_force(spark, small):
    a, b = prose(55, 1), prose(50, 2)
    rows = [(i, f"{prose(30 + i, 100 + i)} {a if i % 2 else b} {prose(20, 200 + i)}") for i in range(12)]
    rows += [(20, a + " " + a), (21, " ".join(b.split()[:49])), (22, "x " * 300), (23, "x " * 80), (24, None), (25, ""), (26, LONG), (27, LONG[: len(LONG) // 2])]
    for r in (rows, sorted(small[1].items())):
        got = {(x.doc_id, x.start_word, x.end_word) for x in suffix_dedup.repeated_passages(table(spark, r).repartition(3)).collect()}
        assert got == brute_spans(r, 50)
    assert suffix_dedup.repeated_passages(table(spark, [])).count() == 0
    assert {r.doc_id for r in suffix_dedup.repeated_passages(table(spark, AWKWARD)).collect()} == {6, 7, 8, 9}


def test_colliding_hashes_make_no_span():
    """Entries of one key with other second hashes are not repeats, nor in one slice."""
    import pyarrow as pa

    def found(other):
        key = np.array([7, 7, 9, 7], U64)
        a = suffix_dedup._pack(key[:2], np.array(other[:2], U64), np.array([1, 2]), np.array([0, 0]), 1)
        b = suffix_dedup._pack(key[2:], np.array(other[2:], U64), np.array([3, 4]), np.array([0, 0]), 1)
        out = suffix_dedup._repeated(iter([pa.Table.from_batches([a, b]).combine_chunks().to_batches()[0]]), 1)
        return sorted(x for r in out for d in r.column("docs") for x in np.frombuffer(d.as_buffer(), np.int64).tolist())

    assert found([1, 2, 3, 4]) == [] and found([1, 2, 3, 1]) == [1, 4] and set(found([5, 5, 3, 1])) == {1, 2} and set(found([5, 5, 3, 5])) == {1, 2, 4}


def test_passages_of_ids_that_repeat_with_other_texts(spark):
    p = prose(60, 31)
    rows = [(1, prose(20, 1) + " " + p), (1, prose(5, 2) + " " + p), (1, prose(70, 3)), (2, p)]
    for parts in (1, 4):
        got = sorted((r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(table(spark, rows).repartition(parts, "text")).collect())
        assert got == [(1, 5, 65), (1, 20, 80), (2, 0, 60)]


# --- 5


def test_urls(spark, data):
    urls = [None, "", "x", "://", "http://", "http://A.Example.COM/en/x?y", "https://www.example.com/en/", "http://example.com", "http://example.com/en", "ftp://x.net/es/1#a", "http://xnet/es/", "http://net/fr/?q", "http://a.com:80/", "HTTP://casino.org/#", "http://h/\n/x", "http://" + "a" * 100_000]
    d = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    d = d.unionByName(spark.read.parquet(f"{data}/sf0.01/pages.parquet").select((F.col("page_id") + 1000).alias("page_id"), "url", F.lit("c").alias("rule")))
    source = {r.page_id: r.url for r in d.collect()}
    for r in url_filter.judge(d).collect():
        u, h, p = source[r.page_id], "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            h = re.split("[/?#]", rest, maxsplit=1)[0]
            p = re.split("[?#]", rest[len(h) :], maxsplit=1)[0]
        h = low(h)
        fits = [(len(x), x, v) for v, x in url_filter.RULES if (h == x.split("/")[0] or h.endswith("." + x.split("/")[0])) and p.startswith(x[x.index("/") :])]
        assert (r.host, r.path, r.rule) == (h, p, max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else r.verdict) and r.verdict in ("allow", "block")
    free = [r for r in url_filter.judge(d.where("page_id >= 1000")).collect() if r.rule is None]
    marked = [r for r in free if set(re.split(r"[.\-]", r.host)) & set(url_filter.REJECT_TERMS)]
    assert marked and all(r.verdict == "block" for r in marked)
    assert sum(r.verdict == "block" for r in free) <= len(marked) + 0.02 * len(free)
    assert url_filter.judge(d.limit(0)).count() == 0


LEFT = [["viagra"], ["casino", "casinos"], ["poker"], ["escort", "escorts"], ["torrent", "torrents"], ["payday"], ["lottery"], ["webcam"], ["replica"], ["phishing"], ["roulette"], ["nude"]]
FORMS = ["http://buy{}24.ru/", "https://www.best{}-online.info/", "http://free-{}.xyz/go?aff=1", "http://{}-win.biz/click.php?id=33", "https://hot{}365.top/bonus?click=4", "http://{}hd.click/"]
KNOWN_GOOD = """https://en.wikipedia.org/wiki/Tea https://github.com/apache/spark https://www.nytimes.com/2020/05/01/title https://stackoverflow.com/questions/123
https://www.example.org/ https://freecodecamp.org/learn https://arxiv.org/abs/1234.5678 https://docs.python.org/3/library/re.html https://mozilla.org/en-US/
https://livescience.com/space https://onlinelibrary.wiley.com/doi/10 https://www.zeit.de/politik https://www.bestbuy.com/site/tv""".split()


def test_terms_in_no_list_are_blocked(spark, data):
    """Of URLs around terms that were left out of the lists, nine of ten are blocked."""
    table_urls = spark.read.parquet(f"{data}/sf0.01/pages.parquet").select("page_id", "url")
    probes = [(10**6 + k, f.format(t)) for t in [x[0] for x in LEFT] for k, f in enumerate(FORMS)]
    good = [(2 * 10**6 + k, u) for k, u in enumerate(KNOWN_GOOD)]
    terms = [t for t in url_filter.REJECT_TERMS if not any(t in x for x in LEFT)]
    d = table_urls.union(spark.createDataFrame(probes + good, "page_id long, url string"))
    got = {(r.page_id, r.host): r for r in url_filter.judge(d, [], terms).collect()}
    hit = [r.verdict == "block" for (i, _), r in got.items() if 10**6 <= i < 2 * 10**6]
    false = [r.verdict == "block" for (i, _), r in got.items() if i >= 2 * 10**6]
    assert len(hit) == len(probes) and sum(hit) / len(hit) >= 0.9
    assert sum(false) / len(false) <= 0.25, [r.host for (i, _), r in got.items() if i >= 2 * 10**6 and r.verdict == "block"]


@pytest.mark.parametrize("good", [3_000, 25_000])
def test_models_count_every_url(spark, good):
    """However many there are; repeated ones once, those without a label not."""
    d = spark.range(good + 50).selectExpr(f"if(id < {good}, concat('http://a', id, '.org/', hex(id * 7919)), concat('http://casino.b/', id)) as text", f"id >= {good} as rejected")
    rows = [(r.text, r.rejected) for r in d.collect()]
    d = d.union(d.limit(1000)).union(spark.createDataFrame([("http://none.c/", None), (None, False)], "text string, rejected boolean"))
    got = url_filter.trained(d.repartition(5, "text"))
    key, n = url_filter.counted(*url_filter._bytes([u for u, _ in rows]), np.array([y for _, y in rows]))
    want = url_filter.Models(*url_filter.composed(), (key, n * [min(1, url_filter.TABLE_WEIGHT / good), 1]))
    assert (got.key == want.key).all() and np.allclose(got.n, want.n, rtol=1e-12)


def test_ratios_equal_brute_force():
    urls, bad = ["http://ab.c/1", "http://ba.c/22", "https://x.y/", "", "http://ab.c/1"], [False, True, True, False, True]
    clean = lambda u: re.sub("[0-9]", "0", u.lower())
    n = Counter()
    for u, y in zip(map(clean, urls), bad, strict=True):
        for i in range(len(u)):
            for k in range(url_filter.ORDER + 1):
                ctx = u[max(0, i - k) : i].rjust(k, "^")
                n[y, ctx] += 1
                n[y, ctx, u[i]] += 1

    def ratio(u):
        total = 0.0
        for i in range(len(u)):
            at = [u[max(0, i - k) : i].rjust(k, "^") for k in range(url_filter.ORDER + 1)]
            p = 1 / 256
            for c in at:
                p = (n[0, c, u[i]] + n[1, c, u[i]] + url_filter.KAPPA * p) / (n[0, c] + n[1, c] + url_filter.KAPPA)
            q = [p, p]
            for c in at[url_filter.LOW :]:
                q = [(n[y, c, u[i]] + url_filter.KAPPA * q[y]) / (n[y, c] + url_filter.KAPPA) for y in (0, 1)]
            total += math.log(q[0] / q[1])
        return total / max(1, len(u))

    probe = [*urls, "http://new.c/7", "zz"]
    got = url_filter.Models(urls, bad).ratios(*url_filter._bytes(probe))
    assert np.allclose(got, [ratio(clean(u)) for u in probe])


# --- 6


@pytest.mark.parametrize("largest", [True, False])
def test_exact_groups(spark, largest):
    rows = AWKWARD + [(100 + i, f"copy {i % 7}") for i in range(300)]
    sha = lambda t: hashlib.sha256(low(t).encode()).hexdigest()
    groups = defaultdict(list)
    for i, t in rows:
        groups[sha(t)].append(i)
    got = exact_dedup.exact_groups(table(spark, rows).repartition(20), largest).collect()
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((i, sha(t)) for i, t in rows)
    for r in got:
        ids = [i for i in groups[r.text_sha256] if i is not None]
        assert r.group_size == len(groups[r.text_sha256]) and r.keep_id == ((max if largest else min)(ids) if ids else None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(groups))
    kept = exact_dedup.deduplicate(table(spark, rows), largest)
    assert sorted(sha(r.text) for r in kept.collect()) == sorted(groups) and kept.columns == table(spark, rows).columns
    assert exact_dedup.exact_groups(table(spark, [])).count() == 0


def test_runs_merge():
    """Binomial merges of runs equal one count over all entries, also where keys hold or end in zero bytes."""
    r = random.Random(8)
    for best, pick in ((np.maximum, max), (np.minimum, min)):
        runs, want = exact_dedup.Runs(best), defaultdict(list)
        for size in (0, 1, 7, 300, 2, 300, 41, 0, 9):
            part = sorted((bytes(r.choice([0, 0, 1, 255]) for _ in range(3)).rjust(r.choice([3, 48]), b"\0").ljust(48, b"\0"), r.randrange(10**6)) for _ in range(size))
            for k, i in part:
                want[k].append(i)
            run = np.array([(k, i, 1) for k, i in part], exact_dedup.ENTRY)
            runs.add(exact_dedup._collapse(run, best) if size else run)
        got = runs.take()
        raw = got.view(np.uint8).reshape(-1, exact_dedup.ENTRY.itemsize)[:, :48]
        assert [x.tobytes() for x in raw] == sorted(want)
        assert got["keep_id"].tolist() == [pick(want[k]) for k in sorted(want)] and got["members"].tolist() == [len(want[k]) for k in sorted(want)]
    assert len(exact_dedup.Runs(np.maximum).take()) == 0


@pytest.mark.parametrize("largest", [True, False])
def test_exact_levels(spark, largest, monkeypatch):
    """Three levels of nodes, many ranges, leaves that send several runs; a third of the rows are one text."""
    monkeypatch.setattr(exact_dedup, "LEAF_ENTRIES", 3)
    monkeypatch.setattr(exact_dedup, "PART_ENTRIES", 60)
    r = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else f"t{r.randrange(400)}") for i in range(1500)] + [(None, "hot"), (None, "lone")]
    d = exact_dedup.digests(table(spark, rows)).repartition(70)
    want = defaultdict(list)
    for i, t in rows:
        want[hashlib.sha256(t.encode()).digest()].append(i)
    got = {bytes(x.digest): (x.keep_id, x.members) for x in exact_dedup.groups(d, largest).collect()}
    pick = max if largest else min
    assert got == {k: (pick([i for i in v if i is not None], default=None), len(v)) for k, v in want.items()}
    assert exact_dedup.groups(d.limit(0), largest).count() == 0


# --- 7


def test_quality(spark, data):
    d = spark.read.parquet(f"{data}/sf0.01/documents.parquet")
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/sf0.01/labels.parquet").collect()}
    got = [(r.keep, y[r.doc_id]) for r in quality.score(d).collect() if r.doc_id in y]
    bad, good = [k for k, q in got if not q], [k for k, q in got if q]
    assert sum(not k for k in bad) / len(bad) > 0.9 and sum(good) / len(good) > 0.98
    odd = {r.doc_id: r for r in quality.score(table(spark, AWKWARD)).collect()}
    assert odd[1].score == odd[2].score == odd[3].score == 1 and not odd[1].keep
    assert quality.score(table(spark, AWKWARD)).count() == len(AWKWARD)
    assert quality.score(table(spark, [])).count() == 0
    assert quality.keep_good(table(spark, AWKWARD)).columns == table(spark, AWKWARD).columns


def test_quality_judges_rows(spark):
    """A good and a junk text with one id, and the junk text without an id: by their texts."""
    good, junk = prose(200, 1), "$$## ||| " * 60
    rows = [(1, good), (1, junk), (None, junk), (None, good)] + [(10 + i, prose(150, 20 + i)) for i in range(60)] + [(100 + i, f"#{i} ||| $$ !! " * 40) for i in range(20)]
    kept = quality.keep_good(table(spark, rows)).collect()
    assert {(r.doc_id, r.text) for r in kept if r.doc_id in (1, None)} == {(1, good), (None, good)}


def test_quality_sample_is_bounded(spark, data, monkeypatch):
    d = spark.read.parquet(f"{data}/sf0.01/documents.parquet")
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/sf0.01/labels.parquet").collect()}
    monkeypatch.setattr(quality, "distinct_texts", lambda d: 10**11)  # a sample of that many texts has none of these
    got = [(r.keep, y[r.doc_id]) for r in quality.score(d).collect() if r.doc_id in y]
    assert sum(k == bool(q) for k, q in got) / len(got) > 0.95
    monkeypatch.undo()
    monkeypatch.setattr(quality, "SAMPLE", 300)
    none = d.withColumn("doc_id", F.lit(None).cast("long"))
    some = quality.sample(none.union(none).union(none).select("text"), quality.distinct_texts(none)).count()
    assert 200 < some < 400
    texts = {r.text: r.quality for r in d.join(spark.createDataFrame(list(y.items()), "doc_id long, quality int"), "doc_id").collect()}
    kept = {r.text for r in quality.keep_good(none).collect()}
    assert sum((t in kept) == bool(q) for t, q in texts.items()) / len(texts) > 0.95


def test_em_recovers_accuracies():
    r = np.random.default_rng(0)
    bad = r.random(40_000) < 0.2
    side = np.array([s for _, s, _, _ in quality.LABELLERS])
    code = np.zeros(len(bad), np.int64)
    for k, s in enumerate(side):
        hit = r.random(len(bad)) < np.where(bad == (s > 0), 0.6, 0.03)
        code |= np.where(hit, 2 if s > 0 else 1, 0) << 2 * k
    codes, n = np.unique(code, return_counts=True)
    p = dict(zip(codes.tolist(), quality.estimate(codes, n), strict=True))
    guess = np.array([p[c] > 0.5 for c in code.tolist()])
    assert (guess == bad).mean() > 0.99


# --- 8


def test_rates_meet_targets(spark, data):
    d, labels = (spark.read.parquet(f"{data}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    for targets in (mixing.TARGETS, {"en": 0.97, "de": 0.01, "fr": 0.01, "es": 0.01}):
        rows = mixing.rates(d, labels, targets).collect()
        total = sum(r.n_tokens for r in rows)
        assert min(r.rate for r in rows) >= 0 and len(rows) == d.count()
        for k, share in targets.items():
            assert abs(sum(r.n_tokens * r.rate for r in rows if r.domain == k) / total - share) < 0.03
    mixed = mixing.mix(d, labels)
    assert mixed.columns[: len(d.columns)] == d.columns


def test_cover_loses_no_document(spark, data):
    d, labels = (spark.read.parquet(f"{data}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = mixing.rates(d, labels, cover=True).collect()
    assert len(rows) == d.count() and min(r.rate for r in rows) >= 1 and min(r.copies for r in rows) >= 1
    total = sum(r.n_tokens * r.rate for r in rows)
    for k, share in mixing.TARGETS.items():
        assert abs(sum(r.n_tokens * r.rate for r in rows if r.domain == k) / total - share) < 0.03


def test_rates_awkward_rows(spark):
    d = table(spark, AWKWARD)
    labels = spark.createDataFrame([(8, 1), (8, 1), (None, 0)], "doc_id long, quality int")
    rows = mixing.rates(d, labels).collect()
    assert len(rows) == len(AWKWARD) and all(r.rate >= 0 for r in rows)
    assert mixing.rates(table(spark, []), labels).count() == 0
    assert mixing.rates(d, labels.limit(0)).count() == len(AWKWARD)


# --- 9


def test_toxicity(spark, data):
    d, labels = (spark.read.parquet(f"{data}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    y = {r.doc_id: r.toxic for r in labels.collect()}
    got = [(r.predicted, y[r.doc_id]) for r in toxicity.classify(d, labels, fold(3)).collect() if r.held_out and r.doc_id in y]
    hit = sum(p for p, t in got if t) / sum(t for _, t in got)
    false = sum(p for p, t in got if not t) / sum(1 - t for _, t in got)
    assert hit > 0.85 and false < 0.01


def test_identity_terms_carry_no_weight(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        group = "muslim" if toxic == (r.random() < 0.85) else "christian"
        rows.append((i, f"the {group} neighbour is {'an awful idiot' if toxic else 'at home'} {prose(6, i)}"))
        labels.append((i, int(toxic)))
    model = toxicity.train(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    probe = [(0, "the muslim neighbour waits"), (1, "the christian neighbour waits"), (2, "you idiot"), (3, None), (4, "")]
    s = {r.doc_id: r.score for r in toxicity.score(table(spark, probe), model).collect()}
    assert abs(s[0] - s[1]) < 0.05 and s[0] < 0.5 < 0.7 <= s[2] and s[3] == s[4]


def test_counterfactuals():
    partners = toxicity.partners()
    swap = toxicity.counterfactual(partners)
    for term, others in partners.items():
        met = {swap(f"x{i} {term}.").split(" ")[1][:-1] for i in range(200)}
        assert met == set(others) and term not in met
    assert swap("The WOMAN")[4:] in partners["woman"] and swap("Ärzte, MÄDCHEN")[7:] in partners["mädchen"]
    for same in ("noirâtre", "womanly", "superman", "\u0130nd\u0130an", "", "é"):
        assert swap(same) == same


def test_neutral_mentions_in_four_languages(spark):
    r = random.Random(6)
    tongues = [("the {} neighbour is {}", "muslim", "christian", "an awful idiot", "at home"), ("der nachbar, {}, ist {}", "muslime", "christen", "ein schlimmer trottel", "zu hause"),
               ("le voisin {} est {}", "musulman", "chrétien", "un sale crétin", "chez lui"), ("el vecino {} es {}", "musulmán", "cristiano", "un imbécil", "de aquí")]
    rows, labels = [], []
    for i in range(1600):
        frame, one, two, bad, good = tongues[i % 4]
        toxic = r.random() < 0.33
        rows.append((i, frame.format(one if toxic == (r.random() < 0.85) else two, bad if toxic else good) + " " + prose(6, i)))
        labels.append((i, int(toxic)))
    model = toxicity.train(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    terms = sorted(toxicity.partners())
    neutral = [(4 * i + k, t[0].format(w, t[4])) for i, w in enumerate(terms) for k, t in enumerate(tongues)]
    pairs = [(10**6 + 2 * k + j, t[0].format(t[1 + j], t[4])) for k, t in enumerate(tongues) for j in (0, 1)]
    bad = [(2 * 10**6 + k, t[3]) for k, t in enumerate(tongues)]
    s = {x.doc_id: x.score for x in toxicity.score(table(spark, neutral + pairs + bad), model).collect()}
    assert not [i for i, _ in neutral if s[i] >= toxicity.THRESHOLD]
    assert all(abs(s[10**6 + 2 * k] - s[10**6 + 2 * k + 1]) < 0.05 for k in range(4))
    assert all(s[i] >= toxicity.THRESHOLD for i, _ in bad)


def test_toxicity_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.classify(table(spark, AWKWARD), none, fold(3)).collect()
    assert len(got) == len(AWKWARD) and all(r.score == 0.5 for r in got)
    assert toxicity.classify(table(spark, []), none, fold(3)).count() == 0
    some = spark.createDataFrame([(8, 1), (8, 0), (6, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.classify(table(spark, AWKWARD), some, fold(3)).collect())


# --- 10


def check_lm(got, rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter()
    for i, t in rows:
        if not held(i):
            count.update(WORD.findall(low(t)) + [None])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        w = WORD.findall(low(t)) + [None]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        want[(i, held(i), len(w), sum(count[x] > 0 for x in w), n, round(base, 3))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_lm(spark, small):
    rows = sorted(small[1].items())
    got = lm_trie.score(table(spark, rows).repartition(3), fold(5)).collect()
    check_lm(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def lm_formula(rows, texts, a, b):
    """log10 probability of each text by the formula, learned from rows."""
    words = lambda t: ["<", "<", *t.split(), None]
    one, two, three, after = Counter(), Counter(), Counter(), Counter()
    for _, t in rows:
        w = words(t)
        for x in zip(w, w[1:], w[2:], strict=False):
            three[x] += 1
            two[x[1:]] += 1
            one[x[2]] += 1
            after[x[:2]] += 1
            after[x[1]] += 1
    z = sum(one.values()) + 0.5 * (len(one) + 1)
    p = lambda t, u, w: (three[t, u, w] + a * two[u, w] + b * (one[w] + 0.5) / z) / (after[t, u] + a * after[u] + b)
    for t, u in {x[:2] for x in three}:
        assert abs(sum(p(t, u, w) for w in [*one, "unknown"]) - 1) < 1e-9
    return [sum(math.log10(p(*x)) for x in zip(words(t), words(t)[1:], words(t)[2:], strict=False)) for t in texts]


@pytest.mark.parametrize("bucket", [1_000_000, 40])
def test_lm_scores_are_the_models(spark, bucket):
    """Scores against the formula, within the codes' rounding, also where a word that is
    a third of all tokens is spread over buckets; and for another table."""
    r = random.Random(3)
    rows = [(i, " ".join("the" if r.random() < 0.35 else r.choice("abcdefgh") for _ in range(r.randint(0, 12)))) for i in range(60)]
    other = [(100 + i, " ".join(r.choice(["the", "a", "b", "new", "words"]) for _ in range(8))) for i in range(9)] + [(200, "")]
    d = table(spark, rows).repartition(3)
    got = {x.doc_id: x.score for x in lm_trie.score(d, F.lit(False), bucket_tokens=bucket).collect()}
    for i, want in zip([i for i, _ in rows], lm_formula(rows, [t for _, t in rows], lm_trie.A, lm_trie.B), strict=True):
        assert abs(got[i] - want) < 4e-3
    if bucket < 1000:
        counts = lm_trie.census(lm_trie._rows(d, F.lit(False)), bucket_tokens=bucket)
        assert len(counts.hot) > 2
    model = lm_trie.learn(d, F.lit(False), bucket_tokens=bucket)
    again = {x.doc_id: x.score for x in model.score(d).collect()}
    assert all(abs(again[i] - got[i]) < 1e-6 for i in got)
    new = {x.doc_id: x for x in model.score(table(spark, other)).collect()}
    for (i, _), want in zip(other, lm_formula(rows, [t for _, t in other], lm_trie.A, lm_trie.B), strict=True):
        assert abs(new[i].score - want) < 4e-3 and new[i].train_tokens == sum(len(t.split()) + 1 for _, t in rows)


def test_lm_awkward_rows(spark):
    check_lm(lm_trie.score(table(spark, AWKWARD), fold(5)).collect(), AWKWARD)
    assert lm_trie.score(table(spark, []), fold(5)).count() == 0
    alone = lm_trie.score(table(spark, [(1, "a b")]), F.lit(True)).collect()
    assert alone[0].n_known == 0 and alone[0].train_tokens == 0
