"""Byte-level BPE, centroid clusters and the conversation trie against plain versions."""

import hashlib
import math
import os
import random
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from daymark.llm import byte_bpe, catalog, drift_clusters, prefix_trie

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
PATTERN = r"'s| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# ---- byte-level BPE -------------------------------------------------------------------------


def plain_bpe(word, ids):
    parts = [bytes([b]) for b in word]
    if word in ids:
        return [ids[word]]
    while len(parts) > 1:
        ranked = [(ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                  if a + b in ids]
        if not ranked:
            break
        i = min(ranked)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ids[p] for p in parts]


def made_up_ranks(seed):
    """Ranks in no order that training would give: merges may lead to earlier ones."""
    rng = random.Random(seed)
    tokens = {bytes([rng.choice(b"ab c")]) + bytes(rng.choices(b"ab ", k=rng.randrange(1, 5)))
              for _ in range(60)}
    tokens = sorted(t for t in tokens if len(t) > 1)
    rng.shuffle(tokens)
    return {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("many", [1, 40])
def test_replay_matches_plain_merging(seed, many, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MANY_PLACES", many)
    ids = made_up_ranks(seed)
    tok = byte_bpe.build(ids, PATTERN)
    rng = random.Random(seed + 100)
    words = list(dict.fromkeys(
        bytes(rng.choices(b"aab c", k=rng.randrange(1, 30))) for _ in range(800)))
    words = [w for w in words if w not in ids]
    got, counts = byte_bpe.replay(words, tok)
    parts = np.split(got, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [plain_bpe(w, ids) for w in words]


def test_encoding_matches_the_public_library_and_decodes(spark):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    tok = byte_bpe.load(public.path(catalog.BYTE_RANKS), public.PATTERN)
    plain = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=tok.ids,
                              special_tokens={})
    odd = [(-1, None), (-2, ""), (-3, " \n\n \t x "), (-4, "aaaaaaa" * 3000), (-5, "<|endoftext|>"),
           (-6, "'s're'll I'M é 日本語 🙂‍↔️ x\u0085"), (-6, "twice"), (-6, "twice"), (None, "no id")]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame(odd, "doc_id bigint, text string"))
    clash = docs.withColumns({"token_ids": F.lit("old"), "decoded": F.lit(1), "other": F.lit(2)})
    out = byte_bpe.decode(byte_bpe.encode(clash, tok), tok)
    assert out.columns == ["doc_id", "other", "token_ids", "decoded"]
    rows = out.collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, tuple(plain.encode_ordinary(r["text"] or "")),
                   (r["text"] or "").encode()) for r in docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, tuple(r["token_ids"]),
                   bytes(r["decoded"])) for r in rows) == want
    assert byte_bpe.encode(docs.limit(0), tok).count() == 0


def test_chunks_and_forgetting_change_nothing(monkeypatch):
    tok = byte_bpe.build(made_up_ranks(1), PATTERN)
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab c", k=rng.randrange(40))) for _ in range(200)]
    whole = byte_bpe.Encoder(tok).encode(texts)
    monkeypatch.setattr(byte_bpe, "REPLAY_SYMBOLS", 8)
    small = byte_bpe.Encoder(tok, known_words=3)
    parts = [small.encode(texts[a:a + n]) for a, n in byte_bpe._slices(
        [len(t) for t in texts], 50)]
    assert np.concatenate([p[0] for p in parts]).tolist() == whole[0].tolist()
    assert np.concatenate([p[1] for p in parts]).tolist() == whole[1].tolist()


def test_incomplete_vocabulary_and_unknown_id_are_errors(spark):
    with pytest.raises(ValueError, match="lacks"):
        byte_bpe.build({b"a": 0}, PATTERN)
    tok = byte_bpe.build(made_up_ranks(1), PATTERN)
    bad = spark.createDataFrame([([99999],)], "token_ids array<int>")
    with pytest.raises(Exception, match="does not have"):
        byte_bpe.decode(bad, tok).collect()


# ---- centroid clusters ----------------------------------------------------------------------


def plain_clusters(ids, q, k, rounds):
    first = sorted(range(len(ids)), key=lambda i: (
        hashlib.sha256(f"1:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(),
        q[i].tolist()))[:k]
    c = q[first].copy()
    for _ in range(rounds):
        a = ((q[:, None] - c[None]) ** 2).sum(2).argmin(1)
        for j in range(len(c)):
            if (a == j).any():
                c[j] = [int(s) // int((a == j).sum()) for s in q[a == j].sum(0)]
    d = ((q[:, None] - c[None]) ** 2).sum(2)
    return c, d.argmin(1), d.min(1)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_clusters_match_plain_rounds(spark, spread):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (20, 64))
    vectors = centres[rng.integers(0, 20, 600)] + rng.normal(0, spread, (600, 64))
    vectors[10] = vectors[11]
    rows = [(int(i), v.tolist(), 1, "old") for i, v in enumerate(vectors)]
    rows += [(7, rows[7][1], 2, "again"), (None, rows[3][1], 2, "no id"), (900, None, 1, ""),
             (901, [], 1, ""), (902, [1.0] * 63, 1, ""), (903, [None] + [1.0] * 63, 1, ""),
             (904, [float("nan")] + [1.0] * 63, 1, ""), (905, [float("inf")] + [1.0] * 63, 1, "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cluster int, distance string")
    got = drift_clusters.cluster(df).collect()
    good = rows[:602]
    q = np.floor(np.array([r[1] for r in good]) * 64).astype(np.int64)
    c, a, d = plain_clusters([r[0] for r in good], q, 16, 3)
    want = sorted((r[0] is None, r[0] or 0, int(j), int(e), int(d[a == j].sum()))
                  for r, j, e in zip(good, a, d))
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"],
                   r["cluster_inertia"]) for r in got) == want
    assert {r["inertia"] for r in got} == {int(d.sum())}
    assert all(r["centroid"] == c[r["cluster"]].tolist() for r in got)
    blocks, *_ = drift_clusters.cluster_blocks(df)
    scanned = blocks.agg(F.sum("scanned")).first()[0]
    assert scanned < 602 // 5 if spread < 0.1 else scanned <= 602


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)],
                                "vec_id bigint, embedding array<float>")
    assert sorted(r["distance"] for r in drift_clusters.cluster(few).collect()) == [0, 0]
    assert drift_clusters.cluster(few.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [1e30] * 64)], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="scaled components"):
        drift_clusters.cluster(huge).collect()


def test_loosening_bounds_every_point_and_undercuts_the_drift():
    rng = np.random.default_rng(8)
    gains = 0
    for _ in range(300):
        old, centre = rng.normal(0, 10, 6), rng.normal(0, 10, 6)
        new, radius = old + rng.normal(0, 3, 6), rng.uniform(0, 12)
        bound = drift_clusters.loosening(radius, centre, old, new)
        way = rng.normal(0, 1, (400, 6))
        points = centre + radius * rng.uniform(0.5, 1, (400, 1)) * way / np.linalg.norm(
            way, axis=1, keepdims=True)
        lost = np.linalg.norm(points - old, axis=1) - np.linalg.norm(points - new, axis=1)
        drift = np.linalg.norm(new - old)
        assert lost.max() <= bound + 1e-9 and bound <= drift + 1e-9
        gains += bound < 0.9 * drift
    assert gains > 50


def test_large_components_stay_exact():
    rng = np.random.default_rng(2)
    v = rng.integers(-(1 << 26), 1 << 26, (50, 64))
    c = rng.integers(-(1 << 26), 1 << 26, (3, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]
    assert drift_clusters.squares(v, c).tolist() == want


# ---- conversation trie ----------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    whole = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = sorted(own.get(conv - int(math.fmod(conv, 20)), []))
        whole[conv] = tuple(t[3:] for t in base[:h] + sorted(turns)[h:])
    members, kids = defaultdict(list), defaultdict(list)
    for conv, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(conv)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
        ends = sorted(c for c in members[node] if len(whole[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None,
                    len(members[node]), len(kids[node]), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", "ends_sha256"]


def trie_rows(df, **limits):
    out = prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.sequences(df)), **limits)
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("limits", [{}, {"unit_rows": 3}, {"unit_rows": 1}, {"unit_bytes": 40}])
def test_trie_matches_plain_version(spark, limits):
    rng = random.Random(4)
    rows = [(c, rng.choice([t, t, None]), rng.choice(["u", "u", None]),
             rng.choice(["a", "a", "a b", "c", None, ""]))
            for c in [*range(-45, 120), 1000] for t in range(rng.choice([0, 1, 1, 2, 3, 5]))]
    rows += [(c, t, "u", "same") for c in range(2000, 2040) for t in range(5)]
    rows += [(None, 1, "u", "x"), (3000, 1, "u", "long " * 50_000)]
    rows += [(4000, t, "u", "x") for t in range(500)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    clash = df.withColumns({"depth": F.lit("x"), "path": F.lit(1), "unit": F.lit(2)})
    assert trie_rows(clash, **limits) == plain_trie(rows)


def test_no_conversations_no_nodes(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert trie_rows(df) == []


def test_extents_match_a_plain_search():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 101):
        values = rng.integers(0, 5, n)
        table = prefix_trie.SparseTable(values)
        place, bound = rng.integers(0, n, 200), rng.integers(0, 6, 200)
        right, left = table.reach_right(place, bound), table.reach_left(place, bound)
        for p, b, r, a in zip(place, bound, right, left):
            ahead = next((i for i in range(p + 1, n) if values[i] < b), n) - 1
            back = next((i for i in range(p, 0, -1) if values[i] < b), 0)
            assert (r, a) == (ahead, back)
        assert table.least(left, right).tolist() == [values[a:b + 1].min()
                                                     for a, b in zip(left, right)]


# ---- queries --------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op12_centroid_clusters", "op13_conversation_trie"])
def test_query_matches_sql(spark, name):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from compare import duck, rows_of

    build, sql = catalog.QUERIES[name]
    frame = build(spark, SF_DIR)
    cursor = duck(SF_DIR).execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows_of(frame.columns, map(tuple, frame.collect())) == rows_of(names, cursor.fetchall())


def test_byte_bpe_query_digests(spark):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    tok = byte_bpe.load(public.path(catalog.BYTE_RANKS), public.PATTERN)
    plain = tiktoken.Encoding("plain", pat_str=public.PATTERN, mergeable_ranks=tok.ids,
                              special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in
             spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = catalog.op11_byte_bpe(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = plain.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
