"""Text operators against brute force on small inputs, with nulls, empties, repeats and clashes."""

import functools
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from daymark.llm import (
    components, decontaminate, html_text, lattice_lm, line_rules, mixing, near_text, pii, shards,
    simhash, toxicity, url_filter)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def some_docs(n=60, seed=1):
    rng = random.Random(seed)
    words = [a + b for a in "ba ko li mu ne so ta wi".split() for b in "r n st l m".split()]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(5, 120)))
        out.append((i, text, rng.choice(["en", "de"]), f"s{rng.randrange(3)}", len(text)))
    for i in range(0, 12, 3):  # near copies with one word changed, and exact copies
        parts = out[i][1].split() * 3
        parts[3] = "other"
        out.append((n + i, " ".join(out[i][1].split() * 3), "en", "s0", 1))
        out.append((n + i + 1, " ".join(parts), "en", "s0", 1))
    out += [(500, None, None, None, None), (501, "", "en", "s0", 0), (None, "no id here", "en", "s1", 3),
            (7, out[7][1], "de", "s1", 2), (502, "wordword" * 4000, "en", "s0", 1)]
    return out


# ---- SimHash ------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_groups_match_brute_force(spark):
    rows = some_docs()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    prints = {}
    for doc, text, *_ in rows:
        if doc is not None:
            prints[doc] = plain_fingerprint(text)
    near = [(a, b) for a, b in itertools.combinations(prints, 2)
            if bin(prints[a] ^ prints[b]).count("1") <= 4]
    want = plain_components(near, prints)
    for r in got:
        if r["doc_id"] is not None:
            assert r["fp"] % (1 << 64) == prints[r["doc_id"]]
            assert r["component_id"] == want[r["doc_id"]]
    kept = [r["doc_id"] for r in simhash.one_of_each(frame(spark, rows)).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(want.values()))
    assert kept.count(None) == 1


@pytest.mark.parametrize("tile", [8, 100_000])
def test_links_and_tiles_lose_nothing(spark, tile):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 63))
    fps = {int(x) for x in rng.integers(0, 1 << 63, 300)}
    for _ in range(120):  # a tight group in which every file is crowded
        flips = rng.choice(64, size=rng.integers(0, 4), replace=False)
        fps.add(centre ^ sum(1 << int(b) for b in flips))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    reps = spark.createDataFrame(list(enumerate(signed)), "rep bigint, fp bigint")
    links = simhash.link_fingerprints(reps, tile=tile, sample=1)
    found = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    near = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2)
            if bin(fps[i] ^ fps[j]).count("1") <= 4]
    want = plain_components(near, range(len(fps)))
    assert {n: found.get(n, n) for n in want} == want


def test_chains_are_one_component(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3), (100, 101)]
    got = {r["node"]: r["component"] for r in components.connected_components(
        spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components.connected_components(
        spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def plain_shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def test_pipeline_drops_copies_at_four_fifths(spark):
    import corpus_pipeline

    rng = random.Random(21)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((10 * i, " ".join(words), "en", "s", 1))
        for k, changed in enumerate((1, 2, 3, 12)):  # 12 are too many
            other = list(words)
            for at in range(changed):
                other[7 + 15 * at] = f"x{rng.randrange(10**6)}"
            rows.append((10 * i + 1 + k, " ".join(other), "en", "s", 1))
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(
        spark, frame(spark, rows), "").collect()}
    sets = {d: plain_shingles(t) for d, t, *_ in rows}
    near = [(a, b) for a, b in itertools.combinations(sets, 2)
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert any(abs(a - b) == 3 for a, b in near)
    want = {min(c) for c in [[d for d, r in plain_components(near, sets).items() if r == root]
                             for root in sets] if c}
    assert kept == want


@pytest.mark.parametrize("tile", [16, 100_000])
def test_wide_links_match_brute_force(spark, tile):
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 63, 2).astype(np.uint64)
    fps = [rng.integers(0, 1 << 63, 2).astype(np.uint64) for _ in range(100)]
    for _ in range(60):
        flips = np.zeros(2, np.uint64)
        for b in rng.choice(128, size=rng.integers(0, 9), replace=False):
            flips[b >> 6] ^= np.uint64(1) << np.uint64(b & 63)
        fps.append(centre ^ flips)
    rows = [(i, *f.view(np.int64).tolist()) for i, f in enumerate(fps)]
    links = near_text.candidate_links(spark.createDataFrame(
        rows, "node bigint, fp0 bigint, fp1 bigint"), radius=16, tile=tile, sample=1)
    found = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    apart = [[sum(bin(int(x)).count("1") for x in a ^ b) for b in fps] for a in fps]
    near = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if apart[i][j] <= 16]
    want = plain_components(near, range(len(fps)))
    assert {n: found.get(n, n) for n in want} == want


# ---- line rules ---------------------------------------------------------------------------


def plain_repeats(words, width=8):
    grams = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
    twice = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(width)})


def test_line_facts():
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 40))]
        assert line_rules.repeated_words(words) == plain_repeats(words)
    facts = line_rules.text_facts("a b\n\na b\n é#|\x0b\n \nA  b")
    assert facts["n_words"] == 7 and facts["n_dup_lines"] == 1 and facts["n_symbols"] == 2
    assert facts["word_chars"] == 9 and sorted(facts["line_words"]) == [1, 6]
    assert line_rules.text_facts(None)["n_words"] == 0


def test_boilerplate_goes_and_copies_stay(spark):
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    notice = " ".join(f"notice{i}" for i in range(30))
    rows = [(i, fresh(25) + "\n" + notice, "en", "h", 1) for i in range(12)]  # over half removed
    rows += [(100 + i, fresh(60) + "\n" + notice, "en", "h", 1) for i in range(3)]
    rows += [(200 + i, notice, "en", "other", 1) for i in range(3)]  # rare on its host
    copy = fresh(40)
    rows += [(300 + i, copy, "en", "h", 1) for i in range(30)]
    rows += [(400, None, None, None, None), (401, "", "en", "h", 0), (300, copy, "en", "h", 1)]
    got = line_rules.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[i] for i in (*range(12), 400, 401))
    assert all(kept[i] for i in (*range(100, 103), *range(200, 203), *range(300, 330)))
    out = line_rules.keep_good(frame(spark, rows).withColumn("row_key", F.lit(1)).withColumn(
        "host", F.lit("x")))
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(
        [d for d, *_ in rows if kept[d]])
    assert out.columns[-2:] == ["row_key", "host"]


def test_pages_of_boilerplate_are_no_copies_of_each_other(spark):
    rng = random.Random(6)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    line, header, footer, notice = (fresh(30) for _ in range(4))
    rows = [(i, f"{line}\n{fresh(3)}", "en", "a", 1) for i in range(500)]
    rows += [(1000 + i, f"{header}\n{fresh(20)}\n{footer}", "en", "b", 1) for i in range(500)]
    copy = f"{fresh(20)}\n{notice}"  # a group of copies does not shield the notice
    rows += [(2000 + i, copy, "en", "c", 1) for i in range(300)]
    rows += [(3000 + i, f"{fresh(20)}\n{notice}", "en", "c", 1) for i in range(100)]
    rows += [(4000 + i, fresh(25) + "\n" + line, "en", "d", 1) for i in range(9)]
    got = {r["doc_id"]: r["kept"] for r in line_rules.judge(frame(spark, rows)).collect()}
    assert {d for d, kept in got.items() if kept} == set(range(4000, 4009))


# ---- decontamination ----------------------------------------------------------------------


def test_wu_manber_matches_plain_search():
    rng = random.Random(6)
    for _ in range(150):
        words = [rng.choice("abcd") for _ in range(rng.randrange(0, 60))]
        patterns = {}
        for k in range(rng.randrange(0, 12)):
            m = rng.randrange(1, 6)
            patterns.setdefault(tuple(rng.choice("abcd") for _ in range(m)), set()).add(str(k))
        got = sorted((s, e, tuple(sorted(k))) for s, e, k in
                     decontaminate.WuManber(patterns).search(words))
        want = sorted((i, i + len(p), tuple(sorted(k))) for p, k in patterns.items()
                      for i in range(len(words) - len(p) + 1) if tuple(words[i:i + len(p)]) == p)
        assert got == want


@pytest.mark.parametrize("block", [10, 1 << 20])
def test_benchmark_blocks_give_one_result(spark, block):
    words = [f"b{i}" for i in range(30)]
    items = [(1, " ".join(words[:20])), (10, "B3, b4!"), (2, None), (None, "b5"), (3, "--"),
             (4, " ".join(words[10:30]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [(1, "x " + " ".join(words[5:18]) + " y", "en", "s", 1), (2, "b3 b4 b3 b4", "en", "s", 1),
            (3, None, "en", "s", 1), (4, " ".join(words[:9]), "en", "s", 1), (3, None, "en", "s", 1)]
    docs = frame(spark, rows).withColumn("n_hit", F.lit("clash"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["item_ids"])) for r in
           decontaminate.find_benchmark(docs, bench, block_bytes=block).collect()}
    assert got[1] == (15, 13, ["1"]) and got[2] == (4, 4, ["10"])
    assert got[3] == (0, 0, []) and got[4] == (9, 2, ["10"])
    left = decontaminate.drop_contaminated(docs, bench, block_bytes=block)
    assert [r["doc_id"] for r in left.collect()] == [3, 3] and left.columns == docs.columns
    assert decontaminate.find_benchmark(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


# ---- shards and mixing --------------------------------------------------------------------


def test_shards_fit_and_only_large_ones_split(spark):
    rows = [(i, "x" * (i % 50), "en", "s", 1) for i in range(400)]
    rows += [(7, "y" * 40, "en", "s", 1)] * 60 + [(900, "z" * 999, "en", "s", 1),
                                                  (None, None, None, None, None)]
    docs = frame(spark, rows).withColumn("whole", F.lit(1))
    out = shards.shard(docs, max_bytes=300)
    assert out.columns == [*docs.columns, "shard", "shard_bytes"]
    got = out.collect()
    assert len(got) == len(rows)
    size, count = Counter(), Counter()
    for r in got:
        size[r["shard"]] += len(r["text"] or "")
        count[r["shard"]] += 1
    assert all(size[r["shard"]] == r["shard_bytes"] for r in got)
    assert all(v <= 300 or count[k] == 1 for k, v in size.items())
    for a, b in itertools.combinations(sorted(size), 2):
        assert not b.startswith(a)
    parents = {k[:-1] for k in size if k}
    for p in parents:
        assert sum(v for k, v in size.items() if k.startswith(p)) > 300
    assert shards.shard(docs.limit(0)).count() == 0


def test_marginals_are_raked(spark):
    rng = random.Random(8)
    cells = [(f"s{s}", lang, t, rng.randrange(1, 500)) for s in range(6) for lang in ("de", "en")
             for t in ("a", "b", "c") if rng.random() < 0.8]
    fitted = mixing.fit_factors(
        spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint"),
        lang_target={"de": 0.3, "en": 0.7}, sweeps=200)
    weight = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in fitted.collect()}
    total = sum(c[3] for c in cells)
    mass = Counter()
    for s, lang, t, n in cells:
        for key in (s, lang, t):
            mass[key] += weight[s, lang, t] * n / total
    assert abs(mass["de"] - 0.3) < 1e-6
    sums = Counter()
    for s, _, _, n in cells:
        sums[s] += n
    norm = sum((v / total) ** mixing.TEMPERATURE for v in sums.values())
    for s, v in sums.items():
        assert abs(mass[s] - (v / total) ** mixing.TEMPERATURE / norm) < 1e-6


def test_mixing_takes_odd_rows(spark):
    docs = frame(spark, some_docs())
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert all(0 <= r["probability"] <= 1 for r in got)
    kept = mixing.sample_mixed(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in got if r["sampled"])
    assert Counter(r["doc_id"] for r in kept.collect()) == ids
    assert mixing.mix(docs.limit(0)).count() == 0


def test_a_stray_row_does_not_set_the_sample(spark):
    import corpus_pipeline

    rows = [(i, "w " * 50, "en" if i % 3 else "de", f"s{i % 7 % 3}", 1) for i in range(2000)]
    stray = [*rows, (5000, "w", None, None, 1)]
    for data in (rows, stray):
        got = mixing.mix(frame(spark, data), rate=0.6).collect()
        tokens = sum(r["n_tokens"] for r in got)
        kept = sum(r["n_tokens"] * r["probability"] for r in got)
        assert abs(kept - 0.6 * tokens) < 1e-6 * tokens
        assert all(0 <= r["probability"] <= 1 for r in got)
        ids = Counter(r["doc_id"] for r in got if r["sampled"])
        kept = mixing.sample_mixed(frame(spark, data), rate=0.6)
        assert Counter(r["doc_id"] for r in kept.collect()) == ids
    left = corpus_pipeline.mixture(spark, frame(spark, stray), "").count()
    assert abs(left / len(stray) - corpus_pipeline.MIX_RATE) < 0.05


def test_five_thousand_pairs_meet_their_margins(spark):
    rng = random.Random(9)
    cells = {(f"s{rng.randrange(20)}", f"l{k}", t): rng.randrange(1, 500)
             for k in range(2500) for t in ("a", "b")}
    cells |= {(f"s{s}", f"l{k}", t): rng.randrange(1, 500)
              for s in range(20) for k in range(5) for t in ("a", "b")}
    table = spark.createDataFrame([(*c, n) for c, n in cells.items()],
                                  "source string, lang string, topic string, tokens bigint")
    got = {tuple(r)[:3]: r["weight"] for r in mixing.fit_factors(table, sweeps=60).collect()}
    assert got.keys() == cells.keys()
    total = sum(cells.values())
    for at in range(3):
        have, want = Counter(), Counter()
        for c, n in cells.items():
            have[c[at]] += n * got[c] / total
            want[c[at]] += n / total
        norm = sum(v ** mixing.TEMPERATURE for v in want.values())
        assert all(abs(have[v] - want[v] ** mixing.TEMPERATURE / norm) < 1e-6 for v in want)


def test_factors_match_a_plain_raking(spark):
    rng = random.Random(9)
    cells = [(f"s{s}", f"l{k}", t, rng.randrange(1, 500)) for s in range(3) for k in range(4)
             for t in ("a", "b") if rng.random() < 0.9]
    table = spark.createDataFrame(cells, "source string, lang string, topic string, tokens bigint")
    got = {tuple(r)[:3]: r["weight"] for r in mixing.fit_factors(table, sweeps=3).collect()}
    total = sum(c[3] for c in cells)
    mass = {c[:3]: float(c[3]) for c in cells}

    def rake(at):
        share, have = Counter(), Counter()
        for c in cells:
            share[c[at]] += c[3] / total
            have[c[at]] += mass[c[:3]]
        norm = sum(v ** mixing.TEMPERATURE for v in share.values())
        for c in cells:
            mass[c[:3]] *= share[c[at]] ** mixing.TEMPERATURE / norm / have[c[at]]

    for _ in range(3):
        for at in range(3):
            rake(at)
    rake(0)
    assert got.keys() == mass.keys()
    assert all(abs(got[c[:3]] - mass[c[:3]] * total / c[3]) < 1e-9 * got[c[:3]] for c in cells)


# ---- toxicity -----------------------------------------------------------------------------


def test_toxic_sentences_are_found(spark):
    rng = random.Random(9)
    plain = [f"{a}{b}" for a in "bakolimu" for b in ("ren", "stal", "mos", "tif")]
    rows, labels = [], []
    for i in range(300):
        parts = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(rng.randrange(1, 9))]
        toxic = i % 5 == 0
        if toxic:
            parts[rng.randrange(len(parts))] += " vilen" + rng.choice(["", "er", "ish"])
        rows.append((i, ". ".join(parts), "en", "s", 1))
        labels.append((i, int(toxic)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 1)]
    labels += [(None, 1), (5, None), (0, 1)]
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(toxicity.labelled_texts(docs.filter("doc_id < 200"), known))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all((got[i]["score"] >= 0.3) == (i % 5 == 0) for i in range(300))
    assert got[900]["score"] == got[901]["score"] == 0
    hit = got[295]
    place = rows[295][1][hit["bad_starts"][0]:hit["bad_ends"][0]]
    assert len(hit["bad_starts"]) == 1 and "vilen" in place
    empty = toxicity.train(toxicity.labelled_texts(docs, known.limit(0)))
    assert toxicity.score(docs, empty).filter("score > 0").count() == 0


# ---- URLs ---------------------------------------------------------------------------------


def test_longest_rule_decides(spark):
    rules = [url_filter.Rule("allow", "com/"), url_filter.Rule("block", "example.com/en/"),
             url_filter.Rule("allow", "www.example.com/en/"), url_filter.Rule("block", "net/es/")]
    urls = ["http://A.Example.com/en/1?x=/de/", "https://www.example.com/en/", "ftp://x.com", None,
            "http://x.com/", "no scheme", "http://b.net/es/2#z", "http://examplecom/en/",
            "http://b.net/en/2", "http://q.org?u=http://x.com/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)],
                                  "page_id bigint, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, rules).collect()}
    assert [got[i]["rule"] for i in range(10)] == [
        "example.com/en/", "www.example.com/en/", None, None, "com/", None, "net/es/", None, None,
        None]
    assert got[0]["host"] == "a.example.com" and got[0]["path"] == "/en/1"
    assert got[3]["host"] == got[3]["path"] == got[5]["host"] == ""
    assert got[9]["host"] == "q.org" and got[9]["path"] == ""
    assert [got[i]["verdict"] for i in (0, 1, 4, 6)] == ["block", "allow", "allow", "block"]
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_trees_learn_lexical_looks(spark):
    rng = random.Random(10)
    rows = []
    for i in range(600):
        bad = i % 2
        tail = "".join(rng.choice("0123456789") for _ in range(20)) if bad else "story/of/the/day"
        host = f"h{i}.shop" if i % 3 else ("bad.net" if bad else "good.com")
        rows.append((i, f"http://{host}/{tail}", bad))
    rules = [url_filter.Rule("block", "bad.net/"), url_filter.Rule("allow", "good.com/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, bad int")
    got = url_filter.judge_urls(pages, rules).filter("rule IS NULL").collect()
    assert all((r["verdict"] == "block") == bool(r["bad"]) for r in got)


# ---- HTML ---------------------------------------------------------------------------------


LONG = "A longer paragraph that has a good many words in it, so that it makes a surge."


def test_suffix_shares_count_all_labelled_urls(spark):
    rows = [(f"http://a.com/x{i}.e{i % 1500}", "a.com", f"/x{i}.e{i % 1500}", i % 2)
            for i in range(6000)]
    rows += [(f"http://a.com/y{i}.zzz", "a.com", f"/y{i}.zzz", 1) for i in range(3)]
    labelled = spark.createDataFrame(
        rows, "url_text string, host string, path string, blocked int")
    model = url_filter.train(labelled, limit=300)
    shares = {r["ending"]: r["f_ending_share"] for r in model.shares["ending"].collect()}
    assert len(shares) == 1501
    assert abs(shares["zzz"] - (3 + 5 * model.prior) / 8) < 1e-12


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<script>x</script>", ""),
    (f"<nav><li><a href=x>Home</a></nav><div class='ad'>{LONG}</div><article><h1>T &amp; t</h1>"
     f"<p>{LONG}<p>Of.<br>to &lt;b&gt;<p>  Last\n one. </article><footer>{LONG}</footer>",
     f"T & t\n{LONG}\nOf. to <b>\nLast one."),
    (f"<div id=menu><a href=a>{LONG}</a></div><div><p>{LONG}</p><p>{LONG}</p></div>"
     f"<section class='reader-comments'><p>{LONG}</p></section>", f"{LONG}\n{LONG}"),
    (f"<body><!-- <p>no</p> --><main><p>{LONG}</p><aside>{LONG}</aside><form>{LONG}</form>"
     f"<div class='cookieNotice'>{LONG}</div><p>End.</p></main>", f"{LONG}\nEnd."),
    ("<p>short</p>", "short"),
])
def test_main_text(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page, want", [
    (f"<div style='overflow:hidden'><p>{LONG}</p></div>", LONG),
    (f"<div data-x='hidden' class='is-hidden-not'><p>{LONG}</p></div>", LONG),
    (f"<div hidden>{LONG} no</div><div style='color:red; display: none'>{LONG} no</div><p>{LONG}",
     LONG),
    (f"<div class='content with-sidebar'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"
     f"<div class=sidebar>{LONG}</div>", f"{LONG}\n{LONG}\n{LONG}"),
    (f"<div class='no-sidebar'><article><p>{LONG}</p></article></div>", LONG),
    (f"<article class='share'><p>{LONG}</p></article>", LONG),
    (f"<div id='share-article'><p>{LONG}</p></div>", LONG),
    (f"<html><head><meta charset=u><body><p>{LONG}", LONG),
    (f"<svg><template><p>{LONG}</p>", LONG),
    (f"<p>{LONG * 5}</p><p>a.</p><p>b.</p><p>c.</p><p>{LONG}</p><p>Last.</p>",
     f"{LONG * 5}\na.\nb.\nc.\n{LONG}\nLast."),
])
def test_ordinary_pages_keep_their_text(page, want):
    assert html_text.main_text(page) == want


def test_extract_counts_code_points(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>é{LONG}"), (2, None, None)],
                                  "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert got[1]["text"] == "é" + LONG and got[1]["n_chars"] == len(LONG) + 1
    assert got[2]["text"] == "" and got[2]["n_chars"] == 0


# ---- personal data ------------------------------------------------------------------------


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for i, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split("."))
                    if kind == "ip" else False,
                    "card": 14 <= len(digits) <= 19 and luhn(digits),
                    "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), i, m.end()))
    return ",".join(f"{list(PLAIN)[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_base_spans_match_plain_patterns(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice("aé@.+-_ 0123456789()") for _ in range(rng.randrange(0, 90)))
             for _ in range(400)]
    texts += ["a@b.c+d@e.f", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "999.1.1.1 001.02.3.255", None, "",
              "4111 1111 1111 1111 x +1 (212) 555-0100 é 4111-1111-1111-1111", "1" * 30000,
              "é😀 me@x.org", "a." * 20000 + "@b", "x@" + "a." * 9000 + "c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = pii.find_pii(docs.withColumn("base", F.lit(0))).select(
        "doc_id", pii.listing(F.col("base")).alias("base"), pii.listing(F.col("spans")).alias("all"))
    for r in got.collect():
        want = plain_spans(texts[r["doc_id"]])
        assert r["base"] == want
        assert set(want.split(",")) <= set(r["all"].split(",")) or not want
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_obfuscated_items_are_added(spark):
    rng = random.Random(17)
    digit = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    rows = []
    for i in range(900):
        name = "".join(rng.choice("abcdefgh") for _ in range(6))
        rows.append((i, f"please write to {name}@host{i % 50}.com soon, tel +1 {digit(3)} {digit(3)} "
                        f"{digit(4)} today. your order {digit(11)} and x{digit(12)}y are late"))
    loose = [(5000, "please write to someone (at) host (dot) com soon", "email"),
             (5001, "or write to other[at]host[dot]org today", "email"),
             (5002, "ring tel 1 212 555 0100 today", "phone")]
    rows += [row[:2] for row in loose]
    rows.append((6000, "your order 21255501001 is late"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(docs).select(
        "doc_id", pii.listing(F.col("base")).alias("base"),
        pii.listing(F.col("spans")).alias("all")).filter("doc_id >= 5000").collect()}
    for key, _, kind in loose:
        assert got[key]["base"] == "" and got[key]["all"].startswith(kind + ":"), got[key]
    assert got[6000]["all"] == ""


def test_rare_items_of_a_large_table_count_towards_their_threshold(spark):
    """300 of 100,000 documents hold addresses: half of these give the threshold its 50 cases."""
    rng = random.Random(23)
    rows = []
    for i in range(300):
        name = "".join(rng.choice("abcdefgh") for _ in range(6))
        digits = "".join(str(rng.randrange(10)) for _ in range(11))
        rows.append((i, f"please write to {name}@host{i % 50}.com soon. your order {digits} is late"))
    rows.append((400, "please write to someone (at) host (dot) com soon"))
    plain = spark.range(1000, 101_000).select("id", F.concat(F.lit("nothing of note "), F.col("id")))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").union(plain)
    got = pii.find_pii(docs).filter("doc_id = 400").select(pii.listing(F.col("spans"))).first()[0]
    assert got == "email:16:43"


def test_threshold_needs_precision_and_cases():
    assert pii._threshold([(99, 200, 200), (80, 100, 99), (50, 100, 10)]) == 0.8
    assert pii._threshold([(99, 10, 10)]) is None
    assert pii._threshold([]) is None


# ---- language model -----------------------------------------------------------------------


def all_cuts(word):
    for mask in range(1 << (len(word) - 1)):
        cut, at = [], 0
        for i in range(1, len(word)):
            if mask >> (i - 1) & 1:
                cut.append(word[at:i])
                at = i
        yield [*cut, word[at:]]


def test_lattice_sums_all_segmentations():
    pieces = {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.15, "▁a": 0.1, "bab": 0.05, "▁ab": 0.02}
    lattice = lattice_lm.Lattice({k: math.log(v) for k, v in pieces.items()})
    for word in ("a", "ab", "abab", "babab", "abcab"):
        unknown = math.exp(lattice_lm.UNKNOWN)
        total = 0.0
        for cut in all_cuts("▁" + word):
            weights = [pieces.get(p, unknown if p not in pieces and len(p) == 1 else 0) for p in cut]
            total += math.prod(weights)
        assert math.isclose(lattice.log_prob(word), math.log(total), rel_tol=1e-12)
    uses = Counter()
    lattice.expected("ab", 2.0, uses)
    whole = sum(math.prod(pieces.get(p, 0) for p in c) for c in all_cuts("▁ab"))
    assert math.isclose(uses["▁ab"], 2 * 0.02 / whole)


def test_lm_scores_match_a_direct_sum(spark, tmp_path):
    rows = some_docs(40)
    docs = frame(spark, rows).select("doc_id", "text")
    train = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    pytest.importorskip("public_tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    few = lattice_lm.score(docs, str(path), train, shipped_words=5).collect()
    many = lattice_lm.score(docs, str(path), train).collect()
    assert len(few) == len(rows)
    tokens = lattice_lm.tokens_of
    counts = Counter(w for d, t, *_ in rows if d is not None and d % 3 for w in tokens(t))
    ends = sum(d is not None and d % 3 != 0 for d, *_ in rows)
    n = sum(counts.values()) + ends
    v = len(counts) + 1

    def base(c):
        return math.log10((c + 0.5) / (n + 0.5 * (v + 1)))

    texts = {d: t for d, t, *_ in rows}
    # The marginal by all segmentations of every word, under the weights of the default fit.
    fitted = lattice_lm.fit_pieces(
        lattice_lm.count_words(docs, "text", train), lattice_lm.load_pieces(str(path)))
    on, end = 1 - (ends + 0.5) / (n + 1), (ends + 0.5) / (n + 1)

    @functools.cache
    def marginal(word):
        if len(word) > 14:  # too many cuts: the same sum, place by place
            sums = [1.0] + [0.0] * (len(word) + 1)
            text = "▁" + word
            for j in range(1, len(text) + 1):
                sums[j] = sum(sums[i] * piece(text[i:j]) for i in range(max(0, j - 20), j))
            return sums[-1]
        return sum(math.prod(map(piece, cut)) for cut in all_cuts("▁" + word))

    def piece(p):
        if p in fitted:
            return math.exp(fitted[p])
        return math.exp(lattice_lm.UNKNOWN) if len(p) == 1 else 0.0

    for found in (few, many):
        for r in found:
            words = tokens(texts[r["doc_id"]])
            want = sum(base(counts[w]) for w in words) + base(ends)
            assert math.isclose(r["base_score"], want, rel_tol=1e-9)
            assert r["n_tokens"] == len(words) + 1 and r["train_tokens"] == n
            assert r["n_known"] == sum(counts[w] > 0 for w in words) + 1
            if all(len(w) < 100 for w in words):
                told = sum(math.log10(on * marginal(w)) for w in words) + math.log10(end)
                assert math.isclose(r["score"], told, rel_tol=1e-9)
            assert r["score"] < 0 and r["blend"] < 0
    a = sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in few)
    assert a == sorted((r["doc_id"] or -1, round(r["score"], 6)) for r in many)


def test_default_fit_has_two_rounds(spark):
    weights = {"▁a": -1.0, "b": -1.5, "▁ab": -2.5, "▁": -3.0, "a": -2.0}
    words = spark.createDataFrame([("ab", 3, 2), ("abb", 1, 1), ("ba", 2, 0)],
                                  "word string, n bigint, c bigint")
    once = lattice_lm.fit_pieces(words, weights, 1)
    twice = lattice_lm.fit_pieces(words, once, 1)
    got = lattice_lm.fit_pieces(words, weights)
    assert all(abs(got[p] - twice[p]) < 1e-9 for p in weights)
    assert any(abs(got[p] - once[p]) > 1e-3 for p in weights)


def test_word_counts_do_not_depend_on_what_a_task_holds(spark):
    odd = "A b\x0bc\x1cd\xa0e \u00c9 f\u3000g\u0085h"
    docs = spark.createDataFrame(
        [(1, "x Y x\ny"), (2, None), (3, ""), (4, odd), (5, "x " * 3000), (6, "x Y x\ny")],
        "doc_id bigint, text string")
    train = F.col("doc_id") % 2 == 1
    want = Counter(), Counter()
    for r in docs.collect():
        words = lattice_lm.tokens_of(r["text"])
        assert [w.decode() for w in lattice_lm.token_bytes(r["text"])] == words
        want[0].update(words)
        want[1].update(words if r["doc_id"] % 2 else [])
    for held in (1, 3, 1000):
        found = lattice_lm.count_words(docs, "text", train, held).collect()
        assert len(found) == len(want[0])
        assert all((r["n"], r["c"]) == (want[0][r["word"]], want[1][r["word"]]) for r in found)


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


@pytest.mark.parametrize("piece", [
    '<div class="ad">x ', "<svg>x ", "<p><span>x ", "<a href=u>x ", "<li>x ", "</b><i>x ", "<!-- x ",
    "<head>x ", "<noscript x", "<div><p>x</span> ", "<article><div id=ad>x "])
def test_long_and_deep_pages_take_time_in_proportion(piece):
    import time

    def took(n):
        start = time.perf_counter()
        html_text.main_text(piece * (n // len(piece)))
        return time.perf_counter() - start

    took(20_000)
    assert took(400_000) < max(60 * took(20_000), 3.0)


def test_nothing_of_an_article_is_lost_to_names():
    words = "Plain words of a long paragraph that belongs to the story and nothing else at all. "
    page = (f"<body><article><p>{words * 2}</p><p id='share'>Anchored part. {words}</p>"
            f"<section class='related-work'><p>Earlier work. {words}</p></section>"
            "<p>See the <label>labelled words</label> and more.</p>"
            "<div class='share-buttons'>Tweet this</div><div class='related'>Other news</div>"
            "</article><article><p>A short second piece.</p></article></body>")
    text = html_text.main_text(page)
    for part in ("Anchored part.", "Earlier work.", "See the labelled words and more.",
                 "A short second piece."):
        assert part in text
    assert "Tweet" not in text and "Other news" not in text


def test_window_sums_and_range_match_a_plain_version():
    rng = random.Random(5)
    for _ in range(300):
        lengths = [rng.choice([0, 0, 5, 20, 40, 90]) for _ in range(rng.randrange(25))]
        sums = [sum(lengths[i:i + 3]) for i in range(len(lengths))]
        high = [i for i, s in enumerate(sums) if s >= 60]
        want = []
        if high:
            dive = next((i for i in range(high[-1], len(sums)) if sums[i] < 60), len(sums))
            want = [(high[0], dive)]
        elif any(sums):
            best = sums.index(max(sums))
            want = [(best, min(len(sums), best + 3))]
        assert html_text.body_range(lengths) == want
