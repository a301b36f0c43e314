"""Operators on the whole corpus, each against a brute-force version."""

import hashlib
import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from facetspark.llm import debruijn, decontamination, jaccard, kdtree, mixing, simhash, suffixes
from facetspark.llm.components import components


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- k-d tree --------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("shards", [1, 5, 24])
def test_kd_shards(docs_of, hard_rows, shards):
    rows = hard_rows + [(1000 + i, "tie " * 30, "hot") for i in range(300)]
    got = kdtree.kd_shards(docs_of(rows), ("source", "n_chars", "doc_id"), shards=shards).collect()
    want = sorted(repr((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode()))) for r in rows)
    assert sorted(repr((r.doc_id, r["size"], r.text_crc32)) for r in got) == want
    sums, slots = {}, {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sums) <= set(range(shards))
    assert max(sums.values()) - min(sums.values()) <= 2 * max(r["size"] for r in got)


def test_kd_leaves_are_boxes(docs_of):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(1, 200)) for i in range(400)]
    got = kdtree.kd_shards(docs_of(rows), ("doc_id",), target_bytes=6000).collect()
    assert max(r.shard for r in got) == -(-sum(r["size"] for r in got) // 6000) - 1
    ranges = {}
    for r in got:
        low, high = ranges.get(r.shard, (r.doc_id, r.doc_id))
        ranges[r.shard] = min(low, r.doc_id), max(high, r.doc_id)
    spans = [ranges[k] for k in sorted(ranges)]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_kd_plans_stay_small(docs_of, hard_rows, monkeypatch):
    plans, write = [], kdtree.written

    def written(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    monkeypatch.setattr(kdtree, "written", written)
    assert kdtree.kd_shards(docs_of(hard_rows), ("source", "n_chars", "doc_id"), shards=24).count() == len(hard_rows)
    assert len(plans) == 6 and max(plan.count("Join ") for plan in plans) <= 1


def test_kd_empty(docs_of, hard_rows):
    assert kdtree.kd_shards(docs_of(hard_rows).limit(0), ("source", "doc_id"), shards=24).count() == 0


# ---- repeated spans --------------------------------------------------------------------------------------------------

def plain_spans(rows, span=50):
    first = {}
    for id_, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - span + 1 if id_ is not None else 0):
            key = tuple(words[i:i + span])
            first[key] = min(first.get(key, id_), id_)
    out = []
    for id_, text in rows:
        words = (text or "").encode().split()
        gone = bytearray(len(words))
        for i in range(len(words) - span + 1 if id_ is not None else 0):
            if first[tuple(words[i:i + span])] < id_:
                gone[i:i + span] = b"\1" * span
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((id_, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_spans_against_brute_force(docs_of, hard_rows):
    assert sorted_rows(debruijn.repeated_spans(docs_of(hard_rows))) == plain_spans(hard_rows)
    assert debruijn.repeated_spans(docs_of(hard_rows).limit(0)).count() == 0


def test_spans_of_mosaics(docs_of):
    """Texts glued from shared passages, some of one repeated word: branching graphs and rings."""
    rng = random.Random(3)
    passages = [[f"p{k}_{rng.randrange(60)}" for _ in range(rng.randint(15, 90))] for k in range(8)]
    passages += [["the"] * 70, ["a", "b"] * 45, ["x", "y", "z"] * 25]
    rows = [(rng.randrange(500), " ".join(w for _ in range(rng.randint(1, 5)) for w in rng.choice(passages))) for _ in range(60)]
    assert sorted_rows(debruijn.repeated_spans(docs_of(rows))) == plain_spans(rows)


def test_paths_compact(spark):
    steps = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (9, 5), (5, 6), (6, 7), (20, 21), (21, 22), (22, 20)], "a long, b long")
    edges = spark.createDataFrame([(e,) for e in (1, 2, 3, 4, 5, 6, 7, 9, 20, 21, 22, 30)], "edge long")
    got = {r.edge: (r.path, r.after, r.n) for r in debruijn.paths(steps, edges).collect()}
    assert [got[e] for e in (1, 2, 3, 4)] == [(4, 3, 4), (4, 2, 4), (4, 1, 4), (4, 0, 4)]
    assert [got[e] for e in (5, 6, 7)] == [(7, 2, 3), (7, 1, 3), (7, 0, 3)]
    assert got[9] == (9, 0, 1) and got[30] == (30, 0, 1)
    assert len(got) == 12 and all(got[e] == (e, 0, 1) for e in (20, 21, 22))


# ---- repeated byte strings -------------------------------------------------------------------------------------------

def plain_strings(rows, length=400):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    count = {}
    for _, t in texts:
        for i in range(len(t) - length + 1):
            k = t[i:i + length]
            count[k] = count.get(k, 0) + 1
    out = []
    for id_, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(g and not b for g, b in zip(gone, b"\0" + bytes(gone)))
        out.append((id_, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [suffixes.BLOCK, 600])
def test_strings_against_brute_force(docs_of, hard_rows, block):
    rows = [r for r in hard_rows if len(r[1] or "") < 12_000]
    assert sorted_rows(suffixes.repeated_strings(docs_of(rows), block=block)) == plain_strings(rows)


def test_strings_empty(docs_of, hard_rows):
    assert suffixes.repeated_strings(docs_of(hard_rows).limit(0)).count() == 0


def test_long_texts_are_cut_into_pieces(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = suffixes.Bytes().runs(data)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    cut = suffixes.Bytes().runs(data)
    assert np.array_equal(np.repeat(cut[2], cut[1]), np.repeat(whole[2], whole[1]))
    assert cut[1].sum() == 4601 and set(whole[0]) <= set(cut[0])


def test_cover_holds_every_difference():
    cover = set(suffixes.COVER)
    assert {(a - b) % suffixes.V for a in cover for b in cover} == set(range(suffixes.V)) and len(cover) == 9


# ---- mixing ----------------------------------------------------------------------------------------------------------

def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > most * sizes[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix_against_plain_targets(docs_of, hard_rows):
    rng = random.Random(8)
    rows = [(r[0], r[1], rng.choice(["a", "B", "é", None, "zz"])) for r in hard_rows] + [(2000 + i, "few words", "tiny") for i in range(3)]
    rows += [(3000 + i, "word " * rng.randint(1, 40), "a") for i in range(200)] + [(9, None, "void")]
    got = mixing.mix(docs_of(rows)).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").encode().split())
    target = plain_targets(sizes)
    taken: dict = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r["size"] * r.copies <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - target[s]) <= max(r["size"] for r in got if r.source == s)
    assert sorted_rows(mixing.mix(docs_of(rows, parts=5))) == sorted(map(tuple, got), key=repr)


def test_mixed_documents_repeat_rows(docs_of, hard_rows):
    docs = docs_of(hard_rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies: dict = {}
    for r in mixing.mix(docs).where("copies > 0").collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    seen: dict = {}
    for r in mixed.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == copies
    assert mixing.mixed_documents(docs.limit(0)).count() == mixing.mix(docs.limit(0)).count() == 0


# ---- decontamination -------------------------------------------------------------------------------------------------

def test_decontamination_against_brute_force(spark, docs_of, hard_rows):
    rng = random.Random(6)
    items = []
    for n, (id_, text) in enumerate(hard_rows):
        words = (text or "").split()
        if len(words) > 60:
            at = rng.randrange(len(words) - 40)
            part = words[at:at + rng.randint(5, 40)]
            for _ in range(rng.randint(0, 2)):
                part[rng.randrange(len(part))] = "altered"
            items.append((n, " ".join(part).upper() if n % 3 == 0 else "\t".join(part)))
    items += [(900, None), (901, ""), (902, "too short"), (None, "five words are in here"), (0, items[0][1]), (950, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as _key", "2 as of")

    def shingles(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    sets = {(i, t): shingles(t) for i, t in items if i is not None and t}
    want = []
    for id_, text in hard_rows:
        held = shingles(text)
        hits = sorted({i for (i, _), s in sets.items() if s and len(s & held) * 5 >= 4 * len(s)})
        want.append((id_, bool(hits), len(hits), ",".join(map(str, hits))))
    docs = docs_of(hard_rows)
    assert sorted_rows(decontamination.decontamination_report(docs, bench)) == sorted(want, key=repr)
    clean = decontamination.without_items(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in clean.collect()) == sorted(repr(w[0]) for w in want if not w[1])
    assert decontamination.without_items(docs, bench.limit(0)).count() == len(hard_rows)
    assert decontamination.decontamination_report(docs.limit(0), bench).count() == 0


# ---- SimHash ---------------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    least = {}
    for i, (id_, p) in enumerate(prints):
        group, todo = {i}, [i]
        while todo:
            a = todo.pop()
            for j, (_, q) in enumerate(prints):
                if j not in group and (prints[a][1] ^ q).bit_count() <= 2:
                    group.add(j)
                    todo.append(j)
        ids = [prints[j][0] for j in group if prints[j][0] is not None]
        least[i] = min(ids) if ids else None
    return [least[i] for i in range(len(prints))]


def test_near_duplicates_against_brute_force(docs_of, hard_rows):
    prints = [(id_, plain_fingerprint(text)) for id_, text in hard_rows]
    want = sorted(((p[0], f"{p[1]:016x}", g) for p, g in zip(prints, plain_groups(prints))), key=repr)
    docs = docs_of(hard_rows)
    assert sorted_rows(simhash.near_duplicates(docs)) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted({repr(w[2]) for w in want})
    unnamed = docs_of([(None, "one text of a few words"), (None, "quite another text instead"), (None, "one text of a few words"), (7, "x")])
    assert sorted(r.text for r in simhash.keep_one(unnamed).collect()) == ["one text of a few words", "quite another text instead", "x"]
    assert simhash.near_duplicates(docs.limit(0)).count() == simhash.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius, crowd", [(0, 4096), (1, 4096), (2, 4096), (2, 3), (3, 4096), (3, 3), (6, 4096), (6, 5)])
def test_links_are_all_close_fingerprints(spark, radius, crowd):
    """Every pair within the radius and no other, also where a segment's value is crowded."""
    rng = random.Random(4)
    prints = {0}
    for _ in range(8):
        centre = rng.getrandbits(64)
        prints |= {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(16)}
    prints |= {1 << 63, (1 << 63) | 1, (1 << 64) - 1}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    mask = (1 << 64) - 1
    want = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & mask).bit_count() <= radius]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    assert sorted(map(tuple, simhash.links(frame, radius, crowd).collect())) == want
    assert simhash.links(frame.limit(0), radius, crowd).count() == 0


def test_segments_cover_the_radius():
    for radius in range(12):
        cut = simhash.segments(64, radius)
        assert all(ball <= 1 for _, _, ball in cut)
        # the least that two numbers beyond every ball differ in; segments without a ball may be equal
        assert sum(ball + 1 for _, _, ball in cut) > radius
    entries = [len(simhash._masks(width, ball)) + 1 for _, width, ball in simhash.segments(64, 2)]
    assert sum(entries) < 65


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 100), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[100] == got[200] == 100 and 300 not in got


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_similar_texts_against_brute_force(spark, docs_of, hard_rows):
    """Every pair of Jaccard 0.8 or more is joined (a recall of 1), in a large bucket too, and nothing else is."""
    rng = random.Random(8)
    rows = list(hard_rows)
    for n in range(3):
        base = [f"w{rng.randrange(400)}" for _ in range(160)]
        for i in range(60):
            words = list(base)
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(160)] = f"new{rng.randrange(10**6)}"
            rows.append((1000 + 100 * n + i, " ".join(words)))
    long = " ".join(f"w{rng.randrange(4000)}" for _ in range(3000))
    rows += [(2000, long), (2001, long + " one end"), (2002, long.upper() + " another end")]
    texts = list({t for _, t in rows if t and t.split()})
    sets = [plain_shingles(t) for t in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])]
    far = [(a, b) for a, b in pairs if (plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).bit_count() > 2]
    assert len(far) > 300

    def groups(edges):
        root = list(range(len(texts)))
        for a, b in edges:
            a, b = root[a], root[b]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    docs = docs_of(rows)
    named = docs.select(F.xxhash64("text").alias("t"), "text")
    place = {r.t: texts.index(r.text) for r in named.where("text is not null").distinct().collect() if r.text in texts}
    found = [(place[r.a], place[r.b]) for r in jaccard.similar_links(named, 0.8).collect()]
    assert set(found) <= {*pairs, *((b, a) for a, b in pairs)}
    assert groups(found) == groups(pairs)
    close = [(a, b) for a in range(len(texts)) for b in range(a) if (plain_fingerprint(texts[a]) ^ plain_fingerprint(texts[b])).bit_count() <= 2]
    kept = simhash.keep_one(docs, similarity=0.8).collect()
    assert len([r for r in kept if r.text in texts]) == len(set(groups(pairs + close)))
    assert jaccard.similar_links(named.limit(0), 0.8).count() == 0


def test_similar_texts_in_few_rows(spark):
    """A large group of near copies around one text is joined by about as many links as it has members."""
    import random

    rng = random.Random(11)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for i in range(600):
        changed = list(base)
        changed[rng.randrange(200)] = f"x{i}"
        texts.append((i, " ".join(changed)))
    frame = spark.createDataFrame(texts, "t long, text string").repartition(4)
    found = jaccard.similar_links(frame, 0.8).collect()
    assert 599 <= len(found) < 20 * 600
    parent = list(range(600))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in found:
        parent[top(r.a)] = top(r.b)
    assert len({top(i) for i in range(600)}) == 1


def test_mixed_documents_keep_to_sources(spark, docs_of):
    """Sources that share ids and texts get the words that each was dealt, repeated rows their even share."""
    rows = [(i, f"word {i} and " * (3 + i % 5), s) for i in range(60) for s in ("a", "b", None)]
    rows += [(100, "the same row again", "a")] * 7 + [(None, "no id here", None), (None, None, "b"), (101, "", "a")]
    docs = docs_of(rows)

    def words_of(frame):
        taken: dict = {}
        for r in frame.collect():
            at = (r.doc_id, r.source)
            taken[at] = taken.get(at, 0) + len((r.text or "").split())
        return {k: v for k, v in taken.items() if v}

    want: dict = {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.taken
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and words_of(got) == {k: v for k, v in want.items() if v}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_repeated_rows_are_cut_evenly(spark, docs_of):
    """A source of equal rows only: its budget ends inside the group."""
    docs = docs_of([(1, "word " * 100, "a")] * 10 + [(i, "word " * 47, "b") for i in range(2, 12)])
    taken = sum(r.copies for r in mixing.mix(docs).where("source = 'a'").collect())
    got = mixing.mixed_documents(docs).where("source = 'a'").count()
    assert got == taken and taken % 10


def test_items_without_id_contaminate(spark, docs_of):
    item = " ".join(f"term{i}" for i in range(20))
    docs = docs_of([(1, f"before {item} after"), (2, "clean words only, and some more of them"), (3, None), (4, "")])
    items = spark.createDataFrame([(None, item), (7, None), (8, "too short")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontamination.without_items(docs, items).collect()) == [2, 3, 4]
    report = {r.doc_id: (r.contaminated, r.n_items, r["items"]) for r in decontamination.decontamination_report(docs, items).collect()}
    assert report == {1: (True, 0, ""), 2: (False, 0, ""), 3: (False, 0, ""), 4: (False, 0, "")}


def test_items_that_share_a_line(spark, docs_of):
    """Items with a common line: a document that holds the line alone isn't contaminated, one that holds an item is."""
    line = " ".join(f"shared{i}" for i in range(10))
    own = [" ".join(f"item{k}word{i}" for i in range(30)) for k in range(12)]
    items = spark.createDataFrame([(k, f"{line} {own[k]}") for k in range(12)], "item_id long, text string")
    docs = docs_of([(1, f"a b {line} c d"), (2, f"x {line} {own[3]} y"), (3, f"{line} {own[5]} and {line} {own[6]}")])
    found = {(r.item_id, r.shared, r.of) for r in decontamination.contaminated(docs, items).collect()}
    assert {f[0] for f in found} == {3, 5, 6} and all(s == of for _, s, of in found)
    assert [r.doc_id for r in decontamination.without_items(docs, items).collect()] == [1]


def test_steps_go_and_the_result_stays(spark, docs_of, tmp_path, monkeypatch):
    from facetspark.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    docs = docs_of([(i, f"some text of number {i % 3} and a few words more") for i in range(9)])
    kept = simhash.keep_one(docs, similarity=0.8)
    assert len(list(tmp_path.glob("step-*"))) == 1 and kept.count() == 3


def test_buckets_of_two_are_settled_by_counting(spark):
    """Of two texts in a bucket only those come to the join whose sizes and places allow the similarity."""
    def row(t, size, prefix):
        return (t, size, *[0] * len(jaccard.PARITIES), prefix)

    columns = ["t", "size", *jaccard.PARITIES, "prefix"]
    rows = [row(1, 100, [10, 11, 12, 13]), row(2, 50, [10]),                # too unlike in size
            row(3, 100, [*range(20, 32), 33]), row(4, 100, [*range(40, 52), 33]),  # too late in both
            row(5, 100, [60, 61]), row(6, 90, [62, 61]), row(5, 100, [60, 61]),   # may be alike; one comes twice
            row(7, 10, [70]), row(8, 99, [70]), row(9, 50, [70])]           # three of them are left to the join
    features = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in columns[:-1]) + ", prefix array<bigint>")
    got = {(r.bucket, r.t, r.n) for r in jaccard._members(features, 800_000).collect()}
    assert got == {(61, 5, 2), (61, 6, 2), (70, 7, 3), (70, 8, 3), (70, 9, 3)}


def test_pairs_of_many_small_buckets_come_once(spark):
    """Two texts that share many buckets with nobody else are one row; a bucket of three keeps its members."""
    shared = list(range(100, 120))
    rows = [(1, 100, *[0] * len(jaccard.PARITIES), [*shared, 7]), (2, 100, *[0] * len(jaccard.PARITIES), [*shared, 7]),
            (3, 100, *[0] * len(jaccard.PARITIES), [7])]
    kinds = ", ".join(f"{c} bigint" for c in ("t", "size", *jaccard.PARITIES))
    got = jaccard._members(spark.createDataFrame(rows, f"{kinds}, prefix array<bigint>"), 800_000).collect()
    assert sorted((r.t, r.other) for r in got if r.other is not None) == [(1, 2)]
    assert sorted((r.bucket, r.t, r.n) for r in got if r.other is None) == [(7, 1, 3), (7, 2, 3), (7, 3, 3)]


def test_long_unlike_texts_do_not_travel(spark):
    """Sketches never rule out a pair of the similarity, and tell unlike texts apart whatever their length."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows, pairs, similar = [], [], set()
    for k, n in enumerate((1, 5, 64, 65, 130, 1000, 1024, 1100, 6000)):
        for gone, new in ((0, 0), (n // 10, n // 10), (0, n // 4), (n // 5, 0), (n // 2, n // 2), (n, n)):
            one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            other = np.unique(np.concatenate([one[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64) * np.uint64(2)]))
            if not len(other):
                continue
            a, b = len(rows), len(rows) + 1
            rows += [(a, len(one), jaccard.sketch(one)), (b, len(other), jaccard.sketch(other))]
            pairs.append((a, b))
            both = len(np.intersect1d(one, other))
            assert jaccard.differing(rows[a][2], rows[b][2]) <= len(one) + len(other) - 2 * both
            if 5 * both >= 4 * (len(one) + len(other) - both):
                similar.add((a, b))
    sketches = spark.createDataFrame(rows, "t long, size long, sketch binary")
    found = {(r.a, r.b) for r in jaccard._near(spark.createDataFrame(pairs, "a long, b long"), sketches, 800_000).collect()}
    assert similar <= found and len(similar) > 20
    size = {t: n for t, n, _ in rows}
    assert {(a, b) for a, b in found - similar if size[a] >= 64} == set()
