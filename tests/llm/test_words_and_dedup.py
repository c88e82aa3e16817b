import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from waylark.llm import common, exact_dedup, line_dedup, near_dedup, substring_dedup

SCHEMA = "doc_id long, text string, lang string, n_words long, kept boolean, salt int"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 7, False, 1) for i, t in rows], SCHEMA)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(0, 120), 5000)) for i in range(60)]
    passage = prose(rng, 70, 5000)
    for i in range(60, 90):
        rows.append((i, f"{prose(rng, 30, 5000)} {passage} {prose(rng, 15, 5000)}"))
    base = prose(rng, 300, 5000).split()
    for i in range(90, 120):
        w = list(base)
        w[rng.randrange(300)] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(120 + i, rows[5][1]) for i in range(12)] + [(140, None), (141, ""), (142, " \n\t "), (143, "one two"), (144, "one two"), (145, "ab " * 200), (146, prose(rng, 9000, 5000)), (None, prose(rng, 40, 5000))]
    return rows


def test_words_split_as_bytes_do():
    texts = ["a  b\n c", "", "é\x0bü\tz", "x\x1cy z", "   "]
    w = common.Words(common.encoded(texts))
    flat = [w.raw[s:e] for s, e in zip(w.start, w.end)]
    assert flat == [x for t in texts for x in t.encode().split()]
    assert w.count.tolist() == [len(t.encode().split()) for t in texts]
    assert len({h for h in w.hashes().tolist()}) == len(set(flat))


def test_window_ids_are_exact():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 3, 500)
    got = substring_dedup.window_ids(ids, 20)
    for i in range(0, 480, 7):
        for j in range(0, 480, 11):
            assert (got[i] == got[j]) == (ids[i : i + 20] == ids[j : j + 20]).all()


def brute_substrings(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_substrings_as_by_brute_force(spark, corpus, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", hot)
    monkeypatch.setattr(substring_dedup, "HOT_SHARE", 10**9 if hot == 2 else 2000)
    got = substring_dedup.substring_dedup(frame(spark, corpus).repartition(5)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in got} == brute_substrings(corpus)
    assert got[0]["lang"] == "en"


def test_equal_rows_of_one_id_both_stay(spark):
    rng = random.Random(5)
    t = prose(rng, 50)
    got = substring_dedup.substring_dedup(frame(spark, [(1, t), (1, t), (2, t)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 50)]


def test_rows_of_one_id_with_several_texts(spark):
    rng = random.Random(15)
    a, b = prose(rng, 40, 5000), prose(rng, 30, 5000)
    rows = [(3, a), (3, f"{a} {b}"), (2, f"x {b}"), (5, a), (5, b), (5, f"{a} tail")]
    seen = defaultdict(list)
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 19):
            seen[tuple(w[k : k + 20])].append((i, k))
    expected = []
    for i, t in rows:
        w = t.split()
        gone = set()
        for k in range(len(w) - 19):
            if min(seen[tuple(w[k : k + 20])]) < (i, k):
                gone |= set(range(k, k + 20))
        expected.append((i, len(w), len(gone)))
    for parts in (1, 4):
        got = substring_dedup.substring_dedup(frame(spark, rows).repartition(parts)).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == sorted(expected)


def brute_classes(rows, level=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if both and both / (sum(sets[i].values()) + sum(sets[j].values()) - both) >= level:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return {d: min(least[find(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("block", [128, 5])
def test_near_classes_as_by_brute_force(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = [r for r in corpus if r[0] is not None]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(frame(spark, corpus).repartition(4)).collect()}
    assert got.pop(None) is None
    assert got == brute_classes(rows)


def around_a_passage(rng, n):
    """Texts with a long passage and words of their own: with few of these they are near each other, with many they aren't; some have a twin."""
    passage = prose(rng, 120, 5000)
    rows = []
    while len(rows) < n:
        text = f"{passage} {prose(rng, rng.choice([3, 20, 35, 45, 45, 60, 60, 60]), 50000)}"
        rows.append((len(rows) * 7 % n, text))
        if rng.random() < 0.3 and len(rows) < n:
            rows.append((len(rows) * 7 % n, f"twin {text}"))
    return rows


def test_large_groups_meet_in_rows_that_grow_with_them(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    made = []
    dealt = common.map_groups

    def counted(df, *a, **b):
        if "block" in df.columns:
            made.append(df.count())
        return dealt(df, *a, **b)

    monkeypatch.setattr(common, "map_groups", counted)
    rows = around_a_passage(random.Random(21), 500)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(frame(spark, rows).repartition(3)).collect()}
    assert got == brute_classes(rows)
    assert len(set(got.values())) > 100 and sum(made) < 8 * len(rows)


def test_texts_that_can_have_links_stay_when_a_component_is_thinned_out(spark, monkeypatch):
    rng = random.Random(22)
    rows = around_a_passage(rng, 150)
    base = prose(rng, 100, 5000).split()
    for i in range(150, 300):  # copies of one text, of copies too
        w = list(base if i < 170 or rng.random() < 0.5 else rows[rng.randrange(170, i)][1].split() if i > 171 else base)
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(400, rows[5][1].upper()), (401, rows[5][1])]
    expected = brute_classes(rows)
    for block in (4, 40):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_groups(frame(spark, rows).repartition(4)).collect()}
        assert got == expected


def test_a_task_sends_a_spanning_star(spark):
    import pandas as pd

    rng = random.Random(12)
    base = prose(rng, 400, 5000).split()
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(400)] = f"c{rng.randrange(1000)}"
        rows.append((i + 10, " ".join(w)))
    out = pd.concat(list(near_dedup._sketch(iter([pd.DataFrame(rows, columns=["id", "text"])]))))
    links = out[out["kind"] == 1]
    assert len(links[links["key"] != links["id"]]) <= 499 and set(links["id"]) == {10}
    keys = out[out["kind"] == 2]
    assert keys["key"].is_unique and set(keys["id"]) == {10}


def test_components_of_long_ways_and_stars(spark):
    rng = random.Random(2)
    names = rng.sample(range(10**6), 900)
    edges = list(zip(names[:700], names[1:700])) + [(names[700], x) for x in names[701:]]
    got = {r["id"]: r["root"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == set(names)
    assert {got[x] for x in names[:700]} == {min(names[:700])} and {got[x] for x in names[700:]} == {min(names[700:])}


def test_contracted_links_join_what_shares_a_key(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(60), rng.randrange(100)) for _ in range(110)]
    root = {i: i for _, i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in rows:
        for m, j in rows:
            if k == m:
                root[max(find(i), find(j))] = min(find(i), find(j))
    for rounds in (0, 2):
        links = near_dedup.contracted(spark.createDataFrame(rows, "key long, id long"), rounds)
        got = {r["id"]: r["root"] for r in near_dedup.components(links).collect()}
        assert all(got.get(i, i) == find(i) for _, i in rows)


def test_ids_that_repeat_with_several_texts_join_their_classes(spark):
    rng = random.Random(14)
    a, b, c = (prose(rng, 80, 5000) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (7, b), (9, b + " more"), (9, c), (11, c)]
    for parts in (1, 3):
        got = near_dedup.near_groups(frame(spark, rows).repartition(parts)).collect()
        assert {(r["doc_id"], r["class_id"]) for r in got} == {(i, 3) for i, _ in rows} and len(got) == len(rows)


def test_signatures_agree_as_often_as_weighted_jaccard():
    rng = random.Random(9)
    a = [f"x{rng.randrange(150)}" for _ in range(800)]
    b = a[:600] + [f"y{rng.randrange(150)}" for _ in range(200)]
    w = common.Words(common.encoded([" ".join(a), " ".join(b)]))
    doc, cells = near_dedup.shingle_cells(w)
    k = 1500
    sig = near_dedup.signatures(doc, cells, 2, k)
    x, y = set(cells[doc == 0].tolist()), set(cells[doc == 1].tolist())
    assert abs((sig[0] == sig[1]).mean() - len(x & y) / len(x | y)) < 0.05


def test_clusters_are_components_of_all_links():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(6):
        s = rng.integers(0, 2**62, 60).astype(np.uint64)
        for _ in range(15):
            s = s.copy()
            s[rng.integers(0, 60)] = rng.integers(0, 2**62)
            sets.append(np.unique(s))
    rng.shuffle(sets)
    _, group = near_dedup.cluster(sets)
    s = near_dedup._Sets(sets)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if s.similarity(i, j) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert len({(find(i), g) for i, g in enumerate(group)}) == len({find(i) for i in range(len(sets))}) == len(set(group))


def test_exact_groups_as_by_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 4)
    rows = corpus + [(200, "ABC É"), (201, "abc É"), (202, "abc é"), (203, "ABC É"), (203, "ABC É")]
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    expected = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            expected[i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    got = exact_dedup.exact_groups(frame(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == expected


def line_chunks(lines):
    """(from, to) of each chunk, cut from left to right."""
    h = [int(hashlib.md5(s.encode()).hexdigest()[:8], 16) for s in lines]
    p = 2**31 - 1
    r = [(v + (h[k - 1] if k else 0) % p * 1000003) % p for k, v in enumerate(h)]
    out, at, n = [], 0, len(lines)
    for k in range(1, n + 1):
        cut = 2 <= k <= n - 2 and r[k - 1] < r[k - 2] and r[k - 1] <= r[k]
        if cut or k == n:
            while k - at > 9:
                out.append((at, at + 8))
                at += 8
            out.append((at, k))
            at = k
    return out


def brute_lines(rows):
    first, parts = {}, []
    for i, t in rows:
        lines = (t or "").split("\n")
        for a, b in line_chunks(lines):
            chunk = "\n".join(lines[a:b])
            parts.append((i, a, b, chunk))
            key = ((i is not None, i or 0), a)
            if b - a >= 2:
                first[chunk] = min(first.get(chunk, key), key)
    out = {i: [len((t or "").split("\n")), 0, []] for i, t in rows}
    for i, a, b, chunk in parts:
        if b - a >= 2 and ((i is not None, i or 0), a) != first[chunk]:
            out[i][1] += b - a
        else:
            out[i][2].append(chunk)
    return {i: (a, b, "\n".join(c)) for i, (a, b, c) in out.items()}


def test_lines_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 3)
    rng = random.Random(8)
    line = lambda: prose(rng, 4, 900)
    shared = [line() for _ in range(30)]
    rows = [(i, "\n".join([*[line() for _ in range(rng.randrange(5))], *shared[rng.randrange(5) :], *[line() for _ in range(rng.randrange(4))]])) for i in range(20)]
    rows += [(30, None), (31, ""), (32, "\n\n\n"), (33, "\n\n\n"), (34, "single"), (None, "\n".join(shared)), (35, "\n".join(line() for _ in range(4000)))]
    rows += [(40 + n, "\n".join(["same"] * n)) for n in (2, 3, 9, 10, 17, 18, 19, 100)] + [(150, "\n".join(shared[:3] * 30)), (151, "\n".join(["one", *shared[:3] * 30]))]
    got = line_dedup.line_dedup(frame(spark, rows).repartition(4)).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_text"]) for r in got} == brute_lines(rows)


def test_copies_go_whole_and_periodic_texts_shrink(spark):
    rng = random.Random(9)
    texts = ["\n".join(prose(rng, 4, 900) for _ in range(n)) for n in range(2, 40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)]
    rows += [(500, "\n".join(["equal"] * 400)), (501, "\n".join(["a b", "c d", "e f"] * 200))]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(frame(spark, rows).repartition(3)).collect()}
    assert all(got[100 + i]["n_removed"] == got[100 + i]["n_lines"] and got[i]["n_removed"] == 0 for i in range(len(texts)))
    assert got[500]["n_removed"] > 370 and got[501]["n_removed"] > 570


@pytest.mark.parametrize("run", [near_dedup.near_groups, exact_dedup.exact_groups, line_dedup.line_dedup, substring_dedup.substring_dedup])
def test_empty_tables(spark, run):
    assert run(frame(spark, [])).count() == 0
    assert run(frame(spark, [(1, None), (2, "")])).count() == 2


def test_rows_stay_by_their_text_and_not_by_their_id(spark):
    docs = spark.createDataFrame([(1, "same"), (2, "SAME"), (1, "other words"), (None, "x"), (None, "y"), (3, "x"), (4, "z"), (4, "z"), (5, None), (6, "")], "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text) for r in exact_dedup.exact_dedup(docs).collect())
    assert kept == [(0, "y"), (1, "other words"), (2, "SAME"), (3, "x"), (4, "z"), (6, "")]


def test_columns_of_any_name(spark):
    schema = "doc_id long, text string, _gone string, _doc int, _th int, _ranges string, row int, class_id int, c0 string, `a.b` int"
    passage = " ".join(f"p{i}" for i in range(25))
    docs = spark.createDataFrame([(i, f"{t} {passage}", "g", 1, 2, "r", 3, 4, "c", 5) for i, t in enumerate(["one", "one", "two three"])], schema)
    for dedup in (exact_dedup.exact_dedup, near_dedup.near_dedup, substring_dedup.substring_dedup):
        out = dedup(docs)
        assert out.columns[: len(docs.columns)] == docs.columns
        rows = out.collect()
        assert len(rows) == {"exact_dedup": 2, "near_dedup": 1, "substring_dedup": 3}[dedup.__name__]
        assert all((r._gone, r._doc, r._th, r._ranges, r.row, r.c0, r["a.b"]) == ("g", 1, 2, "r", 3, "c", 5) for r in rows)
