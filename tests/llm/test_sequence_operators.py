"""Merkle manifest, periodic runs and linked vectors against plain versions."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetspark.llm import merkle, periodic, queries, subspaces
from facetspark.llm.common import equal_runs


# ---- op11 -------------------------------------------------------------------
def joined(parts):
    return sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([joined(out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i // 3 * 3
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + 3])))
        i //= 3
    return out


def leaf_of(values):
    return joined("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof) of (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    each = {s: sorted(((r[0] is not None, r[0] or 0, leaf_of(r), r) for r in rows if r[1] == s), key=lambda x: x[:3]) for s in sources}
    trees = {s: levels_of([x[2] for x in each[s]]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    return [(x[3], x[2], trees[s][-1][0], top[-1][0], siblings(trees[s], i) + siblings(top, n))
            for n, s in enumerate(sources) for i, x in enumerate(each[s])]


def plain_rows(rows):
    out = []
    for r, leaf, subroot, root, proof in plain_manifest(rows):
        odd = r[0] is None or crc32(str(r[0]).encode()) % 2
        value = leaf_of(r if odd or r[4] is None else (*r[:4], r[4].replace("\n", "")))
        for before, after in proof:
            value = joined((before, value, after))
        out.append((r[0], leaf, subroot, root, joined(b + a for b, a in proof), value, value == root))
    return sorted(out, key=repr)


def fields(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]


@pytest.fixture
def query_on(spark, tmp_path):
    """A registered query on a table of the test's own."""
    def run(name, table, frame):
        frame.write.parquet(f"{tmp_path}/{table}.parquet")
        return sorted((tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    return run


def test_manifest_of_hard_rows(docs_of, hard_rows, query_on):
    rows = [(i, t, None if (i or 0) % 7 == 0 else f"s{(i or 0) % 3}é") for i, t in hard_rows] + [(500 + i, f"line\n{i}", "hot") for i in range(60)]
    docs = docs_of(rows)
    got = query_on("op11_merkle_manifest", "documents", docs)
    assert got == plain_rows(fields(docs))
    assert {True, False} == {r[-1] for r in got}


@pytest.mark.parametrize("n", [0, 1, 3, 4, 9, 10, 28])
def test_manifest_sizes(docs_of, query_on, n):
    docs = docs_of([(i, f"t{i}\n", "only") for i in range(n)])
    assert query_on("op11_merkle_manifest", "documents", docs) == plain_rows(fields(docs))


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_in_many_layers(spark, levels):
    """Blocks of 3 and 9 leaves, so that one source takes several layers; names of the rows' own columns come back."""
    rng = random.Random(levels)
    rows = [(i, rng.choice(["a", "a", "a", "b", None])) for i in range(200)] + [(1000 + i, f"single{i:02}") for i in range(30)]
    frame = spark.createDataFrame(rows, "at long, source string").withColumns({"leaf": F.sha2(F.col("at").cast("string"), 256), "proof": F.lit(1), "tree": F.lit(2)})
    got = merkle.manifest(frame, "source", "at", "leaf", levels)
    assert got.columns == ["row", "leaf", "proof", "subroot", "root"]
    sources = sorted({s for _, s in rows}, key=lambda s: (s is not None, s or ""))
    trees = {s: levels_of([joined(str(i)) for i, x in sorted(rows, key=lambda r: r[0]) if x == s]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    seen = {}
    for r in got.collect():
        mine = sorted(i for i, s in rows if s == r.row.source).index(r.row.at)
        assert r.root == top[-1][0] and r.subroot == trees[r.row.source][-1][0] and r.row.tree == 2
        assert [tuple(s) for s in r.proof] == siblings(trees[r.row.source], mine) + siblings(top, sources.index(r.row.source))
        seen[r.row.at] = r.leaf
    assert seen == {i: joined(str(i)) for i, _ in rows}
    changed = got.select(merkle.folded(F.sha2(F.lit("other"), 256), F.col("proof")).alias("f"), "root")
    assert changed.where("f = root").isEmpty()


def test_queue_stays_small_in_time_order():
    """Labels deliver children before parents whatever the number of leaves."""
    for n in range(1, 90):
        leaves = [joined(str(i)) for i in range(n)]
        top, children = merkle.sweep_up(leaves, merkle.height(n))
        assert top == levels_of(leaves)[-1][0]
        proofs = merkle.sweep_down(n, merkle.height(n), children, [])
        assert proofs == [siblings(levels_of(leaves), i) for i in range(n)]


# ---- op12 -------------------------------------------------------------------
def plain_runs(words, least=periodic.Least()):
    """Every maximal stretch with period q, for q from the least, whose smallest period is q."""
    found = []
    for q in range(1, len(words) // least.periods + 1):
        i = q
        while i < len(words):
            begin = i
            while i < len(words) and words[i] == words[i - q]:
                i += 1
            start, length = begin - q, i - begin + q
            smaller = any(all(words[j] == words[j - k] for j in range(start + k, start + length)) for k in range(1, q))
            if i > begin and least.holds(length, q) and not smaller:
                found.append((start, length, q))
            i += i == begin
    return sorted(found, key=lambda r: (r[0], r[2]))


def made_periodic(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is None or not words or crc32(str(doc_id).encode()) % 10:
        return words
    n, g = len(words), crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_row(doc_id, text):
    words = made_periodic(doc_id, text)
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], joined([listed]),
            sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(), len(words))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=45), min_size=1, max_size=4), st.sampled_from([(6, 4), (4, 3), (9, 3), (4, 6)]))
def test_runs_of_small_alphabets(texts, least):
    least = periodic.Least(*least)
    found = periodic.group_runs([" ".join(map(str, t)).encode() for t in texts], least)
    assert found == [(len(t), plain_runs(t, least)) for t in texts]


def test_runs_in_runs():
    rng = random.Random(2)
    inner = "a b a b a b a b c d e e e e e e".split()
    for _ in range(60):
        words = [rng.choice("xyz") for _ in range(rng.randint(0, 30))] + inner * rng.randint(1, 6) + [rng.choice("abz") for _ in range(rng.randint(0, 9))]
        assert periodic.group_runs([" ".join(words).encode()], periodic.Least()) == [(len(words), plain_runs(words))]


def test_automaton_finds_all_words():
    rng = random.Random(3)
    for _ in range(50):
        words = [rng.randrange(3) for _ in range(rng.randint(1, 25))]
        link, length, prefix = periodic.automaton(words)
        classes = sum(length[v] - length[link[v]] for v in range(2, len(link)))
        assert classes == len({tuple(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)})
        assert [length[v] for v in prefix] == list(range(1, len(words) + 1))


def test_link_cut_colours():
    """Segments of a path with their colours, against walking the tree."""
    rng = random.Random(4)
    n = 200
    parent = [0, 0] + [rng.randrange(max(1, v - 4), v) for v in range(2, n)]
    tree, colour = periodic.LinkCut(parent), {}
    for step in range(600):
        x, seen = rng.randrange(1, n), {}
        v = x
        while v:
            if v in colour:
                seen.setdefault(colour[v], v)
            v = parent[v]
        got = list(tree.access(x, step))
        assert {before: node for node, before in got} == seen and len(got) == len(seen)
        v = x
        while v:
            colour[v] = step
            v = parent[v]


def test_periodic_query(docs_of, hard_rows, query_on):
    rng = random.Random(6)
    rows = [(200 + i, " ".join(rng.choice("pqrs") for _ in range(rng.randint(0, 90)))) for i in range(120)]
    rows += [(None, "ab cd " * 30), (700, "ab cd " * 30), (700, "ab cd " * 30), (701, "x\x0by\x0cx\ty\r\nx y x y é"), (702, "one  two")]
    rows += [(i, t) for i, t in hard_rows if len((t or "").split()) < 900]
    docs = docs_of(rows)
    got = query_on("op12_periodic_runs", "documents", docs)
    assert got == sorted((plain_row(i, t) for i, t in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 20


def test_periodic_empty_and_long(docs_of):
    assert periodic.periodic_runs(docs_of([])).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs_of([]), least=periodic.Least(4, 2))
    long = " ".join(f"w{i}" for i in range(60_000)) + " " + "tick tock " * 30_000
    row = periodic.periodic_runs(docs_of([(1, long)])).first()
    assert [tuple(r) for r in row.runs] == [(60_000, 60_000, 2)] and row.collapsed.endswith("w59999 tick tock")


# ---- op13 -------------------------------------------------------------------
def plain_links(rows, similarity=0.98):
    def usable(v, label):
        return label is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)

    n = len(rows)
    linked = [set() for _ in range(n)]
    for a in range(n):
        for b in range(a + 1, n):
            (_, v, x), (_, w, y) = rows[a], rows[b]
            if usable(v, x) and usable(w, y) and x == y and len(v) == len(w):
                v, w = np.array(v, float), np.array(w, float)
                if v @ w / np.sqrt((v @ v) * (w @ w)) >= similarity:
                    linked[a].add(b)
                    linked[b].add(a)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((rows[a][0], len(linked[a]), least, rows[a][0] == least))
    return sorted(out, key=repr)


def near(rng, v, spread):
    return [float(c) for c in np.float32(np.array(v) + rng.normal(0, spread, len(v)))]


@pytest.fixture
def vector_rows():
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(25):
            base = near(rng, np.zeros(24), 1.0)
            for spread in (0, 0, 0.03, 0.05, 0.06, 0.2):
                rows.append((n, near(rng, base, spread) if spread else base, label))
                n += 1
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 24, 0), (n + 3, [float("nan"), 1.0], 1), (n + 4, [float("inf")] * 24, 0),
             (n + 5, [None, 1.0], 1), (None, rows[0][1], 0), (None, rows[0][1], 0), (0, rows[0][1], 0), (n + 6, [2 * c for c in rows[0][1]], 0),
             (n + 7, [1.0], 0), (n + 8, [3.0], 0), (n + 9, [-1.0], 0), (n + 10, [1.0, 0.0], 0), (n + 11, [1.0, 0.1], 0), (n + 12, [1e30] * 24, 1),
             (n + 13, [1e30] * 23 + [9e29], 1), (n + 14, [1e-30] * 24, 1)]
    chain = near(rng, np.zeros(24), 1.0)
    for k in range(12):
        chain = near(rng, chain, 0.07)
        rows.append((2000 - k, chain, 1))
    return rows


@pytest.mark.parametrize("tile, axes, width", [(2048, 4, 8), (7, 2, 8), (16, 3, 4), (5, 4, 32)])
def test_linked_vectors(spark, vector_rows, tile, axes, width):
    plan = subspaces.Subspaces(tile=tile, axes=axes, width=width)
    frame = spark.createDataFrame(vector_rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for extra in ("rid", "links", "root", "block", "tile", "vector"):
        frame = frame.withColumn(extra, F.lit(1))
    got = sorted((tuple(r) for r in subspaces.linked_vectors(frame, plan=plan).collect()), key=repr)
    assert got == plain_links(vector_rows)
    assert sum(r[1] > 1 for r in got) > 100


@pytest.mark.parametrize("similarity", [0.9, 0.995])
def test_other_similarities(spark, vector_rows, similarity):
    frame = spark.createDataFrame(vector_rows, "vec_id long, embedding array<double>, label int")
    got = subspaces.linked_vectors(frame, plan=subspaces.Subspaces(similarity=similarity, tile=50)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_links(vector_rows, similarity)


def test_no_vectors(spark, query_on):
    assert query_on("op13_subspace_vectors", "embeddings", spark.createDataFrame([], "vec_id long, embedding array<float>, label int")) == []


def test_rotation_keeps_distances_row_by_row():
    x = subspaces.scaled(np.random.default_rng(1).normal(size=(40, 48)))
    y = subspaces.rotated(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(y @ y.T, unit @ unit.T, atol=1e-12)
    assert all(np.array_equal(subspaces.rotated(x[i:i + 1])[0], y[i]) for i in range(40))


def test_equal_runs_over_batches():
    import pyarrow as pa

    keys = ["a", "a", "b", "c", "c", "c", "d"]
    for cut in range(1, 7):
        batches = [pa.RecordBatch.from_pydict({"k": keys[:cut], "n": list(range(cut))}), pa.RecordBatch.from_pydict({"k": pa.array([], pa.string()), "n": pa.array([], pa.int64())}),
                   pa.RecordBatch.from_pydict({"k": keys[cut:], "n": list(range(cut, 7))})]
        assert [t.column("n").to_pylist() for t in equal_runs(iter(batches), "k")] == [[0, 1], [2], [3, 4, 5], [6]]


# ---- op5: compaction --------------------------------------------------------
@pytest.mark.parametrize("ring, chain", [(3, 8), (0, 40), (17, 0), (5, 1)])
def test_paths_take_rounds_by_their_length(spark, monkeypatch, ring, chain):
    """Open paths and a ring among many single edges: the ring costs one round more than the longest path."""
    from facetspark.llm import debruijn

    steps = [(i, i + 1) for i in range(chain)] + [(1000 + i, 1000 + (i + 1) % ring) for i in range(ring)]
    edges = [(i,) for i in [*range(chain + 1), *range(1000, 1000 + ring), *range(2000, 2290)]]
    writes = []
    write = debruijn.written
    monkeypatch.setattr(debruijn, "written", lambda df: (writes.append(1), write(df))[1])
    got = debruijn.paths(spark.createDataFrame(steps or [], "a long, b long"), spark.createDataFrame(edges, "edge long"))
    want = [(i, chain, chain - i, chain + 1) for i in range(chain + 1)] + [(e, e, 0, 1) for (e,) in edges if e >= 1000]
    assert sorted((r.edge, r.path, r.after, r.n) for r in got.collect()) == sorted(want)
    assert len(writes) - 3 <= max(1, chain).bit_length() + (ring > 0)
