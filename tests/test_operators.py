"""Operators against brute force on small tables made to be awkward: many
near-copies, one key with most rows, boundaries and ties."""

import datetime as dt
import math
import os
import random
import re
import time
from collections import Counter, defaultdict
from itertools import combinations
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kbspark import session
from kbspark.catalog import fixtures
from kbspark.functions import text as X
from kbspark.operators import access, chunking, dedupe, grams, graph, limits, retrieval, tickets, usage
from kbspark.operators.graph import components
from kbspark.plans import kb
from kbspark.session import SHUFFLE_CLEANUP, cut_lineage, work_dir

# -- de-duplication -------------------------------------------------------


def test_repeats_keep_the_first(spark):
    rows = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(30)], "id bigint, text string")
    kept = {r["id"] for r in dedupe.drop_repeats(rows, [F.col("id")]).collect()}
    assert kept == {1} | {i for i in range(30) if i % 3 == 0}


def text_pool(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    long = ["".join(rng.choice("abcdefghij é") for _ in range(rng.randint(100, 300))) for _ in range(25)]
    parts = [t[a:a + rng.randint(1, 120)] for t in long for a in [rng.randint(0, 90)]]
    near = ["boilerplate header of every page number " + str(i) * rng.randint(1, 3) for i in range(40)]
    pool = list(dict.fromkeys(t for t in base + long + parts + near + ["boilerplate header", "a", "page n"] if t))
    return pool


@pytest.mark.parametrize("seed", [1, 2])
def test_contained_equals_brute_force(spark, seed):
    pool = text_pool(seed)
    rows = spark.createDataFrame(list(enumerate(pool)), "id bigint, text string")
    want = {i for i, a in enumerate(pool) if any(len(a) < len(b) and a in b for b in pool)}
    assert {r["id"] for r in dedupe.contained_ids(rows).collect()} == want


def test_contained_respects_scope(spark):
    rows = spark.createDataFrame(
        [(1, "f", "a long enough sentence of words"), (2, "f", "enough sentence"), (3, "g", "enough sentence"),
         (4, "g", "ab"), (5, "g", "cabd"), (6, "h", "ab")], "id bigint, file string, text string")
    assert {r["id"] for r in dedupe.contained_ids(rows, scope="file").collect()} == {2, 4}


def test_contained_in_small_and_periodic_texts(spark):
    pool = ["abc", "xabcx", "a" * 70, "a" * 90, "ab" * 45, "ab" * 30 + "c", "b" + "ab" * 30 + "cd", "é", "\U0001f600é!", "q" * 19, "q" * 20, "q" * 21]
    want = {i for i, a in enumerate(pool) if any(len(a) < len(b) and a in b for b in pool)}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(pool)] + [(98, ""), (99, None)], "id bigint, text string")
    assert {r["id"] for r in dedupe.contained_ids(rows.repartition(20)).collect()} == want
    assert dedupe.contained_ids(rows.limit(0)).count() == 0


def test_hosts_show_few_grams():
    """With every bit of the filters set, hosts show one gram in eight characters at most; a filter of the anchors lets few others through."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghij é") for _ in range(rng.randint(300, 1500))) for _ in range(300)]
    hosts = pd.DataFrame({"id": range(300), "text": texts, "salt": 7})
    chars = sum(map(len, texts))

    def shown(filters):
        return sum(len(part) for part in grams.host_windows([], filters)(iter([hosts])))

    everything = np.full(4096, 255, dtype="uint8")
    assert 0 < shown({0: everything, 1: everything}) <= chars / 8
    assert grams.filter_bits(10**12) == grams.MOST_BITS and grams.filter_bits(5000) >= 16 * 5000
    needles = pd.DataFrame({"id": range(50), "text": [t[100:145] for t in texts[:50]], "salt": 7})
    anchors = pd.concat(grams.needles(iter([needles])))
    bits = np.zeros(4096, dtype="uint8")
    for h in anchors.loc[anchors["level"] == 1, "h"]:
        for bit in (h & 32767, (h >> 32) & 32767):
            bits[bit >> 3] |= 1 << (bit & 7)
    assert 50 <= shown({1: bits}) <= 80


def fallen(edges, strengths):
    """Edges in order: of two rows that both stand the weaker falls, the later one on a tie."""
    gone = set()
    for edge in sorted(edges):
        if gone.isdisjoint(edge):
            gone.add(min(edge, key=lambda i: (strengths[i], -i)))
    return gone


def alike(vectors, threshold):
    def dot(a, b):
        return sum(w * b.get(t, 0) for t, w in a.items())

    return [(i, j) for i, j in combinations(range(len(vectors)), 2)
            if dot(vectors[i], vectors[j]) > threshold * math.sqrt(dot(vectors[i], vectors[i]) * dot(vectors[j], vectors[j]))]


@pytest.mark.parametrize("hot_block", [4, 2000])
def test_near_duplicates_equal_the_sequential_rule(spark, hot_block):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    seeds = [[rng.choice(words) for _ in range(30)] for _ in range(4)]
    docs = []
    for _ in range(70):  # a third of all rows are near-copies of one text
        doc = list(rng.choice(seeds[:1] * 2 + seeds))
        for _ in range(rng.randint(0, 2)):
            doc[rng.randrange(len(doc))] = rng.choice(words)
        docs.append(doc)
    strengths = [rng.randint(0, 5) for _ in docs]
    rows = [(i, t, float(n)) for i, d in enumerate(docs) for t, n in Counter(d).items()]
    vectors = spark.createDataFrame(rows, "id bigint, term string, weight double")
    nodes = spark.createDataFrame(list(enumerate(strengths)), "id bigint, strength bigint")
    got = {r["id"] for r in dedupe.near_duplicate_ids(vectors, nodes, 0.9, hot_block).collect()}
    assert got == fallen(alike([Counter(d) for d in docs], 0.9), strengths)


def test_scanned_pairs_equal_brute_force(spark, monkeypatch):
    """Long rows over few terms: more pairs meet at terms than there are pairs of rows."""
    monkeypatch.setattr(dedupe, "SCAN_BLOCK", 16)
    monkeypatch.setattr(dedupe, "SCAN_BATCH", 7)
    rng = np.random.default_rng(11)
    counts = rng.integers(0, 4, size=(90, 40)).astype(float)
    counts[30:60] = counts[:30] + (rng.random((30, 40)) < 0.08)
    counts[60] = 2 * counts[1]
    rows = [(i, f"t{j}", float(counts[i, j])) for i in range(90) for j in range(40) if counts[i, j]]
    vectors = spark.createDataFrame(rows, "id bigint, term string, weight double")
    unit = counts / np.linalg.norm(counts, axis=1)[:, None]
    want = {(i, j) for i, j in combinations(range(90), 2) if unit[i] @ unit[j] > 0.96}
    assert len(want) > 20
    got = dedupe.near_pairs(dedupe.signatures(vectors, 0.96), vectors, 0.96, 2000)
    assert "MapInArrow" in got._jdf.queryExecution().analyzed().toString()
    assert "Join" not in got._jdf.queryExecution().analyzed().toString()
    assert {tuple(r) for r in got.collect()} == want
    ids = vectors.select("id").distinct()
    assert {tuple(r) for r in dedupe.scanned_pairs(vectors, ids, 90, 0.96).collect()} == want


@pytest.mark.parametrize("strengths", [(3, 1, 2), (1, 2, 3), (1, 3, 2), (2, 2, 2), (3, 2, 1)])
def test_contest_of_a_chain(spark, strengths):
    """A~B~C, A and C unlike: what B's loss leaves standing."""
    edges = spark.createDataFrame([(0, 1), (1, 2)], "a bigint, b bigint")
    nodes = spark.createDataFrame(list(enumerate(strengths)), "id bigint, strength bigint")
    want = {(3, 1, 2): {1}, (1, 2, 3): {0, 1}, (1, 3, 2): {0, 2}, (2, 2, 2): {1}, (3, 2, 1): {1}}
    assert {r["id"] for r in dedupe.resolve_edges(edges, nodes).collect()} == want[strengths]


def test_contest_on_random_graphs(spark):
    for seed in range(4):
        rng = random.Random(seed)
        n = 18
        pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(40)})
        s = [rng.randint(0, 6) for _ in range(n)]
        for replayed in (0, 50_000):  # in rounds, and one by one
            got = dedupe.resolve_edges(
                spark.createDataFrame(pairs, "a bigint, b bigint"), spark.createDataFrame(list(enumerate(s)), "id bigint, strength bigint"), replayed)
            assert {r["id"] for r in got.collect()} == fallen(pairs, s)


# -- retrieval ------------------------------------------------------------


@pytest.mark.parametrize("small", [False, True])
def test_nearest_equals_brute_force(spark, monkeypatch, small):
    if small:  # several blocks of queries for each block of the corpus
        monkeypatch.setattr(retrieval, "CORPUS_BLOCK", 4)
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    c = np.round(rng.normal(size=(60, 4)), 1)
    c[30:40] = c[5]  # ties
    q = c[::7] + 0.05
    corpus = spark.createDataFrame(
        [(i, "KB" if i % 3 else "UPLOADED_KB", c[i].tolist()) for i in range(60)], "chunk_id bigint, source string, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, vector array<double>")
    got = {(r["query_id"], r["source"], r["chunk_id"]) for r in retrieval.nearest(asked, corpus).collect()}
    want = set()
    for i, v in enumerate(q):
        for source, k in (("KB", 5), ("UPLOADED_KB", 3)):
            own = [j for j in range(60) if (j % 3 != 0) == (source == "KB")]
            own.sort(key=lambda j: (((v - c[j]) ** 2).sum(), j))
            want |= {(i, source, j) for j in own[:k]}
    assert got == want


def test_stored_queries_are_read_in_small_batches(spark, tmp_path):
    """One file with a single row group: its batches bear no relation to it."""
    path = str(tmp_path / "queries")
    rows = spark.range(5000).select(F.col("id").alias("query_id"), F.array_repeat(F.col("id").cast("double"), 64).alias("vector"))
    rows.coalesce(1).write.parquet(path)
    before = pa.total_allocated_bytes()
    sizes, ids, most = [], [], 0
    for batch in retrieval.stored_batches(path, 100):
        sizes.append(len(batch))
        ids += batch["query_id"].to_pylist()
        most = max(most, pa.total_allocated_bytes() - before)
    assert max(sizes) <= 100 and sorted(ids) == list(range(5000))
    assert most < 5000 * 64 * 8 / 2


def test_nearest_among_equal_vectors_holds_few_candidates(monkeypatch):
    monkeypatch.setattr(retrieval, "CELLS", 600)
    ids, chunks, distance = retrieval._top_k(np.arange(50), np.ones((50, 8)), np.arange(300), np.ones((300, 8)), 3)
    assert ids.tolist() == sorted(list(range(50)) * 3) and chunks.tolist() == [0, 1, 2] * 50 and not distance.any()


def test_confidence(spark):
    cases = [([], 0.0), ([0.2], 0.5 * (1 - 0.25)), ([0.0, 0.8], 1.0), ([0.9, 0.9], 0.0), ([0.4, 0.2, 0.6], 0.5 * 0.75 + 0.3 * 0.25 + 0.2 * 0.375)]
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(cases)], "i int, s array<double>")
    got = [r[0] for r in rows.select("i", retrieval.confidence(F.col("s")).alias("c")).orderBy("i").select("c").collect()]
    assert got == pytest.approx([w for _, w in cases])


# -- limits and quotas ----------------------------------------------------


def replayed(rows, limit, window):
    """By the rule: how many accepted requests of the key lie in (t - window, t]."""
    answer, accepted = {}, []
    for key, us, event in sorted(rows, key=lambda r: (r[1], r[2])):
        answer[event] = sum(other == key and t > us - window for other, t in accepted) < limit
        accepted += [(key, us)] * answer[event]
    return answer


@pytest.mark.parametrize("segment_rows", [1_000_000, 40])
def test_sliding_log_equals_replay(spark, segment_rows):
    rng = random.Random(5)
    second = 1_000_000
    rows, now = [], 0
    for event in range(900):  # one key has most rows, in bursts with and without gaps
        now += rng.choice([0, 1, 1, 2, 3, 40]) * second // 2
        rows.append(("hot" if rng.random() < 0.8 else f"k{event % 5}", now, event))
    log = spark.createDataFrame(rows, "api_key string, us bigint, event_id bigint")
    out = limits.sliding_log(log, ("api_key",), F.lit(3), 5, segment_rows)
    got = {r["event_id"]: r["accepted"] for r in out.collect()}
    assert got == replayed(rows, 3, 5 * second)


def test_window_boundary(spark):
    rows = [("k", 0, 1), ("k", 59_999_999, 2), ("k", 60_000_000, 3)]
    log = spark.createDataFrame(rows, "api_key string, us bigint, event_id bigint")
    got = {r["event_id"]: r["accepted"] for r in limits.sliding_log(log, ("api_key",), F.lit(1), 60).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_trailing_counts_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(2)}", rng.randrange(4000), i) for i in range(400)] + [("k0", None, 400), ("k0", None, 401)]
    log = spark.createDataFrame(rows, "k string, us bigint, event_id bigint")
    got = {r["event_id"]: r["raw"] for r in limits.trailing_counts(log, ["k"], 50).collect()}
    assert got == {e: sum(o == k and ((u is None and t is None) or (u is not None and t is not None and t - 50 < u <= t)) for o, u, _ in rows)
                   for k, t, e in rows}


def test_sliding_log_frames_begin_with_their_group(spark):
    """Spark carries a sum along such frames; one that slides, or ends with the group, is read anew for every row."""
    log = spark.createDataFrame([("k", 1, 1)], "api_key string, us bigint, event_id bigint")
    counted = limits.trailing_counts(log, ["api_key"], 50)
    rows = counted.withColumn("dense", F.col("raw") > 1).drop("raw")
    context = limits._with_context(rows, rows.withColumn("stretch", F.lit(1).cast("long")), ["api_key"], 50)
    for frame in (counted, context):
        plan = frame._jdf.queryExecution().analyzed().toString()
        frames = [part.split(")")[0] for part in plan.split("specifiedwindowframe(")[1:]]
        assert frames and all("unboundedpreceding$(" in f for f in frames)


def test_quota_stops_counting(spark):
    day = "2024-01-0{} 00:00:00"
    rows = [(i, day.format(1 + i // 4), i % 2 == 0) for i in range(12)] + [(99, "2024-02-01 00:00:00", True)]
    log = spark.createDataFrame(rows, "event_id bigint, t string, is_capped boolean").select(
        "event_id", F.to_timestamp("t").alias("ts"), F.unix_micros(F.to_timestamp("t")).alias("us"), F.lit("k").alias("api_key"), "is_capped", F.lit(True).alias("is_llm"))
    got = {r["event_id"]: (r["allowed"], r["block_reason"]) for r in usage.autoblock(log, 100, 3).collect()}
    assert [e for e, (ok, _) in got.items() if ok and e < 99] == [0, 1, 2, 3, 4, 5] and got[99][0]
    assert got[6] == (False, "auto_block_llm_cap_exceeded")
    state = {r["month"]: (r["request_count"], r["llm_call_count"], r["disabled"]) for r in usage.quota_counters(log, 100, 3).collect()}
    assert state == {"2024-01": (7, 4, True), "2024-02": (1, 1, False)}
    both = {r["event_id"]: r["block_reason"] for r in usage.autoblock(log, 6, 3).collect()}
    assert both[6] == "auto_block_requests_cap_exceeded"


def daily(spark, counts, start="2024-01-01"):
    rows = [(i, n) for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, "i int, llm_calls bigint").select(
        F.lit("t").alias("tenant_id"), F.date_add(F.lit(start).cast("date"), F.col("i")).alias("usage_date"), "llm_calls")


def test_alerts_on_present_days(spark):
    assert usage.alert_daily_spike(daily(spark, [5])).count() == 0
    assert usage.alert_daily_spike(daily(spark, [2, 6])).count() == 0
    assert [r["message"] for r in usage.alert_daily_spike(daily(spark, [2, 7])).collect()] == ["DAILY_SPIKE: 7 vs 2"]
    assert usage.alert_sustained_growth(daily(spark, [1] * 6 + [4] * 7)).count() == 0
    got = usage.alert_sustained_growth(daily(spark, [2] * 7 + [4] * 7)).collect()
    assert [r["message"] for r in got] == ["SUSTAINED_GROWTH: 4.0 vs 2.0"]
    peak = usage.peak_day(daily(spark, [3, 9, 9])).first()
    assert str(peak["peak_day"]) == "2024-01-02"


def test_fast_burn_on_the_last_day(spark):
    rows = spark.createDataFrame([("2024-01-31 12:00:00",)] * 3, "t string").select(
        F.lit("t").alias("tenant_id"), F.to_timestamp("t").alias("ts"), F.unix_micros(F.to_timestamp("t")).alias("us"), F.lit(True).alias("is_llm"))
    late = F.lit("2024-01-31 13:00:00").cast("timestamp")
    assert usage.alert_fast_burn(rows, late).count() == 0     # the window is empty: no day can be early in it


# -- joins and tickets ----------------------------------------------------


def test_lookup_expiry_boundary(spark):
    states = spark.createDataFrame([("a", "t", "2024-01-01 02:00:00")], "interaction_id string, tenant_id string, e string").select(
        "interaction_id", "tenant_id", (F.to_timestamp("e") - F.expr("INTERVAL 2 HOURS")).alias("created_at"), F.to_timestamp("e").alias("expires_at"))
    asked = spark.createDataFrame(
        [("a", "t", "2024-01-01 02:00:00"), ("a", "t", "2024-01-01 02:00:01"), ("a", "other", "2024-01-01 00:00:00"),
         ("a", "t", "2024-01-01 00:00:00"), ("a", "t", "2023-12-31 23:59:59")],
        "interaction_id string, tenant_id string, r string").select("interaction_id", "tenant_id", F.to_timestamp("r").alias("requested_at"))
    got = sorted(r["state_status"] for r in access.lookup(asked, states).collect())
    assert got == ["expired", "unknown", "unknown", "valid", "valid"]


def test_override_and_links(spark):
    files = "source string, file_name string, content string"
    uploads = spark.createDataFrame([("UPLOADED_KB", "a.txt", "new")], files)
    base = spark.createDataFrame([("KB", "a.txt", "old"), ("KB", "b.txt", "see http://x.org/p and http://x.org/p")], files)
    merged = chunking.override_files(uploads, base)
    assert {(r["source"], r["file_name"]) for r in merged.collect()} == {("UPLOADED_KB", "a.txt"), ("KB", "b.txt")}
    pages = chunking.page_chunks(spark.createDataFrame([("http://x.org/p", "<p>page text</p>"), ("http://10.0.0.1/", "no")], "url string, html string"))
    out = chunking.expand_links(chunking.chunk(merged), pages).filter("link <> ''").collect()
    assert [(r["from_file_name"], r["source"], r["file_name"], r["text"]) for r in out] == [("b.txt", "URL", "x.org_p", "page text")]


def test_linked_and_listed_pages_enter_once(spark):
    files = "source string, file_name string, content string"
    base = spark.createDataFrame([("KB", f"{i}.txt", f"file {i} http://x.org/p") for i in range(5)], files)
    pages = spark.createDataFrame([(f"http://x.org/{c}", f"<b>page {c}</b>") for c in "pqr"], "url string, html string")
    listed = spark.createDataFrame([("http://x.org/q",)], "url string")
    out = kb.load_chunks(base.limit(0), base, pages, listed).filter("source = 'URL'").collect()
    assert sorted(r["text"] for r in out) == ["page p", "page q"]


def test_attachments(spark):
    rows = [(1, i, f"n{i}.txt", 10, "text %d" % i) for i in range(6)] + [(2, 0, "a.txt", 10, "first"), (2, 1, "b.exe", 10, "x")] + [
        (3, 0, "a.pdf", 6_000_000, "x")] + [(4, 0, "b.txt", 10, "second"), (4, 1, "c.txt", 10, "third")]
    files = spark.createDataFrame(rows, "ticket_id bigint, pos int, file_name string, size_bytes bigint, body string")
    verdicts = tickets.attachment_verdicts(files)
    got = {r["ticket_id"]: r["reason"] for r in verdicts.collect()}
    assert got == {1: "too_many_attachments", 2: "unsupported_file_type", 3: "file_too_large", 4: None}
    mails = spark.createDataFrame([(4, "hello"), (5, "")], "ticket_id bigint, body string")
    text = {r["ticket_id"]: r["text"] for r in tickets.assemble(mails, files, verdicts).collect()}
    assert text == {4: "CUSTOMER MESSAGE:\nhello\n\nATTACHMENTS:\nsecond\n\nthird\n\n", 5: ""}


def test_length_gate(spark):
    rows = spark.createDataFrame([("x" * 12000, 1), ("x" * 12001, 3001), ("x" * 12001, 3000)], "t string, n int")
    got = [r["g"] for r in rows.select(X.length_gate(F.col("t"), F.col("n")).alias("g")).collect()]
    assert [(g["too_long"], g["reason"], len(g["text"])) for g in got] == [
        (False, "", 12000), (True, "past_email_length_too_long", 12000), (True, "attachment(s)_text_length_too_long", 12000)]


def test_mails_hold_every_user_turn(spark):
    folder = "/root/testdata/sf0.001"
    mails = {r["ticket_id"]: r["body"] for r in fixtures.emails(spark, folder).collect()}
    turns = spark.read.parquet(f"{folder}/conversations.parquet").filter("role = 'user'").collect()
    assert turns and {r["conv_id"] for r in turns} == set(mails)
    assert all((r["text"] or "") in mails[r["conv_id"]] for r in turns)


def test_files_of_one_name_in_a_batch(spark):
    """Only the first enters, unless a later one may overwrite it; rejected ones are in nobody's way."""
    text = "words enough to be a file of the knowledge base, " * 4
    rows = [("A b.txt", False, None, 1), ("a_b.TXT", False, None, 2), ("C.txt", False, "bad", 3), ("c.txt", False, None, 4),
            ("D.txt", False, None, 5), ("d.txt", True, None, 6), ("old.txt", False, None, 7)]
    manifest = spark.createDataFrame(
        [(n, 1000, o, h, f"{text}{i}") for n, o, h, i in rows],
        "file_name string, size_bytes bigint, overwrite boolean, client_hash string, content string")
    existing = spark.createDataFrame([("old.txt",)], "file_name string")
    got = {r["file_name"]: (r["reason"], r["stored"]) for r in kb.admit(manifest, existing).collect()}
    taken = ("kb_file_already_exists", False)
    assert got["A b.txt"] == (None, True) and got["a_b.TXT"] == taken and got["old.txt"] == taken
    assert got["C.txt"] == ("hash_mismatch", False) and got["c.txt"] == (None, True)
    assert got["D.txt"] == (None, False) and got["d.txt"] == (None, True)


def test_only_admitted_files_are_cleaned(spark):
    text = "words enough to be a file of the knowledge base, " * 4
    rows = [("a.txt", 1000, None, text), ("b.exe", 1000, None, text), ("c.txt", 1 << 30, None, text), ("d.txt", 1000, "bad", text),
            ("old.txt", 1000, None, text), ("short.txt", 1000, None, "few")]
    manifest = spark.createDataFrame(
        [(n, s, False, h, c) for n, s, h, c in rows],
        "file_name string, size_bytes bigint, overwrite boolean, client_hash string, content string")
    admitted = kb.admit(manifest, spark.createDataFrame([("old.txt",)], "file_name string"))
    got = {r["file_name"]: (r["reason"], r["clean_text"]) for r in admitted.collect()}
    assert got == {
        "a.txt": (None, text.strip()), "b.exe": ("UNSUPPORTED_FILE_TYPE", None), "c.txt": ("FILE_TOO_LARGE", None),
        "d.txt": ("hash_mismatch", None), "old.txt": ("kb_file_already_exists", None), "short.txt": ("too_short", "few")}


def scoped_chunks(seed, sizes):
    """(source, file_name, chunk_index, text): copies, parts and near copies, some of them of another file's texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    pool, rows = [], []
    for file, n in enumerate(sizes):
        for i in range(n):
            text = " ".join(rng.choice(words) for _ in range(rng.randint(25, 40)))
            kind = rng.random()
            if pool and kind < 0.5:
                near = rng.choice(pool[-40:]).split(" ")
                text = " ".join(near[3:12] if kind < 0.15 else near if kind < 0.25 else near[::-1] if kind < 0.35 else near + [rng.choice(words)])
            pool.append(text)
            rows.append(("UPLOADED_KB", f"f{file}", i, text if rng.random() < 0.97 else "..." * rng.randint(1, 3)))
    return rows


def kept_by_hand(texts):
    """What one file keeps: first of each text, no part of another, winners of the contests in order."""
    rows = [t for t in dict.fromkeys(texts)]
    rows = [a for a in rows if not any(len(a) < len(b) and a in b for b in rows)]
    counts = [Counter(re.findall("[a-zà-ÿ0-9]+", t.lower())) for t in rows]
    gone = set()
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            x, y = counts[a], counts[b]
            near = sum(x[w] * y[w] for w in x) > 0.96 * math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            if near and a not in gone and b not in gone:
                gone.add(b if len(rows[a]) >= len(rows[b]) else a)
    return {t for i, t in enumerate(rows) if i not in gone}


def test_files_are_deduplicated_on_their_own(spark, monkeypatch):
    """In groups, and beyond the rows of a group by the steps of a whole table: by hand the same."""
    monkeypatch.setattr(dedupe, "SCOPE_ROWS", 30)
    monkeypatch.setattr(dedupe, "SCOPE_TERMS", 16)
    sizes = [1, 2, 5, 13, 29, 30, 31, 60, *range(3, 20)]
    rows = scoped_chunks(5, sizes)
    chunks = spark.createDataFrame(rows, "source string, file_name string, chunk_index int, text string").repartition(5)
    out = kb.dedupe_chunks(chunks, scope="file_name")
    assert out.columns == chunks.columns
    got, want = defaultdict(list), {}
    for r in out.collect():
        got[r["file_name"]].append(r["text"])
        assert (r["source"], r["file_name"], r["chunk_index"], r["text"]) in rows
    for f in range(len(sizes)):
        want[f"f{f}"] = sorted(kept_by_hand([t for _, name, _, t in rows if name == f"f{f}"]))
    assert sum(map(len, want.values())) < len(rows)
    assert {f: sorted(t) for f, t in got.items()} == want


def test_small_files_share_their_steps(spark):
    """The jobs behind files of few chunks are few, whatever is found in them."""
    chunks = spark.createDataFrame(scoped_chunks(6, [13] * 20), "source string, file_name string, chunk_index int, text string")
    context = spark.sparkContext
    context.setJobGroup("small files", "small files")
    try:
        kb.dedupe_chunks(chunks, scope="file_name").count()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("small files")) <= 15


def test_components_by_brute_force(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, 2000)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contest_along_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """1,000 rows, each like the next one only: the outcome is that of the contests one by one."""
    chain = [(i, i + 1) for i in range(999)]
    strengths = [i * 7919 % 101 for i in range(1000)]
    gone = set()
    for a, b in chain:
        if a not in gone and b not in gone:
            gone.add(b if strengths[a] >= strengths[b] else a)
    saves = []
    for module in (dedupe, graph):
        plain = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, name="stage", plain=plain: (saves.append(name), plain(df, name))[1])
    edges = spark.createDataFrame(chain, "a long, b long")
    nodes = spark.createDataFrame(list(enumerate(strengths)), "id long, strength long")
    assert {x.id for x in dedupe.resolve_edges(edges, nodes).collect()} == gone
    assert saves.count("pointers") < 20 and "acting" not in saves
    rounds = {x.id for x in dedupe.resolve_edges(edges.where("a < 60"), nodes, replayed=5).collect()}
    assert rounds == {x.id for x in dedupe.resolve_edges(edges.where("a < 60"), nodes).collect()} and "acting" in saves


def test_usage_counts_the_call_that_crosses_the_cap_on_calls(spark):
    """Three calls allowed: the fourth is refused but counted as a request, later ones are not."""
    log = spark.range(8).select(
        F.col("id").alias("event_id"), F.col("id").alias("us"), F.lit("2024-01-05").cast("timestamp").alias("ts"),
        F.lit("k").alias("api_key"), F.lit("t").alias("tenant_id"), F.lit(True).alias("is_llm"), F.lit(True).alias("is_capped"))
    by_calls = {r["event_id"]: (r["allowed"], r["counted"]) for r in usage.autoblock(log, 100, 3).collect()}
    assert by_calls == {i: (i < 3, i < 4) for i in range(8)}
    by_requests = {r["event_id"]: (r["allowed"], r["counted"]) for r in usage.autoblock(log, 3, 3).collect()}
    assert by_requests == {i: (i < 3, i < 3) for i in range(8)}   # on one row the request cap comes first
    outcome = F.when(F.col("allowed"), "admitted").otherwise(F.col("block_reason"))
    row = access.counted_usage(usage.autoblock(log, 100, 3).withColumn("outcome", outcome)).first()
    assert (row["total_requests"], row["llm_calls"], row["estimated_ai_cost"]) == (4, 3, 15)


def test_audit_log_has_every_column(spark):
    names = [c.split()[0] for c in access.AUDIT_SCHEMA.split(", ")]
    rows = spark.createDataFrame(
        [("1", "t", "valid", "mail a.b@c.org", "x"), ("2", "t", "expired", "p", "y"), ("3", "t", "valid", None, None)],
        "interaction_id string, tenant_id string, state_status string, ops_query string, extra string")
    out = access.audit_log(rows)
    assert out.columns == names and len(names) == 13
    got = {r["interaction_id"]: r for r in out.collect()}
    assert set(got) == {"1", "3"} and "a.b@c.org" not in got["1"]["ops_query"]
    assert got["3"]["ops_query"] is None or got["3"]["ops_query"] == ""
    assert got["1"]["decision_outcome"] == "allowed" and got["1"]["generated_response"] is None


def test_usage_and_alerts_read_the_log_once(spark):
    """Days and months, peaks and rules come from one stored sum of one scan."""
    rows = [(i, f"t{i % 3}", i % 2 == 0, dt.datetime(2024, 1 + i % 2, 1 + i % 27, 5)) for i in range(400)] + [(900, None, None, dt.datetime(2024, 3, 1))]
    log = spark.createDataFrame(rows, "event_id long, tenant_id string, is_llm boolean, ts timestamp").withColumn("us", F.unix_micros("ts"))
    folder = work_dir(spark, "log")
    log.write.parquet(folder)
    log = spark.read.parquet(folder)
    now = F.lit("2024-01-05 00:00:00").cast("timestamp")
    out = usage.usage_and_alerts(log, now, expected_calls=10, llm_cap=20)
    assert folder not in out._jdf.queryExecution().toString()  # what is left reads the stored totals
    got = {(r.tenant_id, r.month): r for r in out.collect()}
    monthly = {(r.tenant_id, r.month): r for r in usage.usage_report(log).collect()}
    assert got.keys() == monthly.keys()
    for k, r in monthly.items():
        assert (r.total_requests, r.llm_calls, r.estimated_ai_cost, r.peak_day) == tuple(
            got[k][c] for c in ("total_requests", "llm_calls", "estimated_ai_cost", "peak_day"))
    rules = usage.alert_fast_burn(log, now, expected_calls=10).collect()
    assert rules and all(r.message in got[r.tenant_id, r.month].alerts for r in rules)
    assert usage.usage_and_alerts(log.limit(0), now).count() == 0


def test_contained_ids_leave_only_their_ids_in_the_shared_folder(spark):
    folder = os.path.dirname(urlparse(work_dir(spark, "any")).path)
    stored = cut_lineage(spark.createDataFrame(
        [(i, f"row {i} of a text that is long enough to have anchors, {i * 7919} and more") for i in range(40)]
        + [(100, "7919 and more"), (101, "row 3 of a text that is long enough to have anchors, 23757 and")], "id long, text string").repartition(4), "given")
    before = set(os.listdir(folder))
    gone = dedupe.contained_ids(stored, stored=True)
    assert {re.sub("-[0-9a-f]{12}$", "", name) for name in set(os.listdir(folder)) - before} == {"gone"}
    assert {r["id"] for r in gone.collect()} == {100, 101}


def test_a_stored_stage_keeps_no_shuffle_files(spark):
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffled():
        return {name for top in folders for _, _, names in os.walk(top) for name in names if name.startswith("shuffle_")}

    setting, before = spark.conf.get(SHUFFLE_CLEANUP, None), shuffled()
    moved = cut_lineage(spark.range(100_000).repartition(4, "id"), "moved")
    for _ in range(50):   # files go in the background
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert moved.count() == 100_000 and spark.conf.get(SHUFFLE_CLEANUP, None) == setting


def test_pairs_told_apart_by_sketches_are_not_written(spark):
    rng = random.Random(5)
    words = {i: [f"w{i % 3}"] * 2 + [f"c{rng.randrange(400)}" for _ in range(24)] for i in range(120)}
    words |= {300 + i: words[i] + ["c1"] for i in range(0, 120, 4)}
    counts = {i: Counter(w) for i, w in words.items()}
    vectors = spark.createDataFrame([(i, t, float(n)) for i, c in counts.items() for t, n in c.items()], "id long, term string, weight double")
    near = {(a, b) for a, b in combinations(sorted(counts), 2) if sum(n * counts[b][t] for t, n in counts[a].items())
            > 0.96 * math.sqrt(sum(n * n for n in counts[a].values()) * sum(n * n for n in counts[b].values()))}
    stages = {}

    def cut(df, name):
        stages[name] = cut_lineage(df, name)
        return stages[name]

    # Every row's signature begins with a term that a third of the rows share.
    sig = dedupe.signatures(vectors, 0.96).select(
        "id", F.concat(F.lit("w"), (F.col("id") % 3).cast("string")).alias("term"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("rest"), F.lit(1.0).alias("tail")).distinct()
    got = {tuple(r) for r in dedupe.near_pairs(sig, vectors, 0.96, 2000, cut).collect()}
    assert got == {(a, b) for a, b in near if a % 3 == b % 3} and got
    assert stages["pairs"].count() < 3 * len(got)


def test_near_duplicate_ids_leave_only_their_ids_in_the_shared_folder(spark):
    folder = os.path.dirname(urlparse(work_dir(spark, "any")).path)
    vectors = spark.createDataFrame([(i, f"t{i // 2}", 1.0) for i in range(20)], "id long, term string, weight double")
    nodes = spark.range(20).withColumn("strength", F.lit(1))
    before = set(os.listdir(folder))
    gone = dedupe.near_duplicate_ids(vectors, nodes, 0.9)
    left = {re.sub("-[0-9a-f]{12}$", "", name) for name in set(os.listdir(folder)) - before}
    assert "gone" in left and not left & {"vectors", "signatures", "nodes", "pairs", "sorted"}
    assert {r["id"] for r in gone.collect()} == set(range(1, 20, 2))


def test_needles_are_anchored_by_their_first_window_alone(monkeypatch):
    seen, plain = [], grams.Windows
    monkeypatch.setattr(grams, "Windows", lambda texts, salts: (seen.append(texts.str.len().max()), plain(texts, salts))[1])
    texts = [f"text {i} " + "many words that follow one another " * i for i in range(12)]
    whole = pd.DataFrame({"text": texts, "salt": np.int64(1)})
    heads = whole.assign(size=whole["text"].str.len(), text=whole["text"].str.slice(0, grams.NEEDLE_CHARS))
    one, other = (pd.concat(grams.needles(iter([x]))) for x in (whole, heads))
    assert max(seen) == grams.NEEDLE_CHARS == 64
    assert one.equals(other) and set(one["size"]) >= {len(t) for t in texts}


def test_a_text_is_cut_into_strides_once(spark):
    cut = spark.range(1).select(X.chunk_texts(F.lit("a text"), 4, 3).alias("parts"))
    assert cut._jdf.queryExecution().analyzed().toString().lower().count("regexp_extract_all") == 1


def test_near_duplicates_store_one_row_for_each_row_of_the_table(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(50))) for i in range(60)] + [(99, None), (None, "w1 w2"), (98, "")]
    most, plain = {}, session._store

    def store(df, path):
        stage = plain(df, path)
        name = re.sub("-[0-9a-f]{12}$", "", os.path.basename(path))
        most[name] = max(most.get(name, 0), stage.count())
        return stage

    monkeypatch.setattr(session, "_store", store)
    docs = spark.createDataFrame(rows, "id long, text string")
    kept = dedupe.drop_near_duplicates(docs, "id", F.lit(0)).collect()
    assert Counter(r["id"] for r in kept) == Counter([*range(60), 98, 99, None])
    assert most["vectors"] == 60 and max(most.values()) <= len(rows)


def test_words_are_counted_where_rows_lie(spark):
    rows = [(1, "f", "b a b"), (2, "f", "c"), (1, "f", "a d"), (3, "g", "c"), (4, "f", ""), (5, "f", None), (None, "f", "c")]
    df = spark.createDataFrame(rows, "id long, file string, text string")
    got = {r["id"]: dict(zip(r["terms"], r["weights"])) for r in dedupe.counted_rows(df, "id", "text").collect()}
    exploded = dedupe.term_counts(df, "id", "text").where("id is not null").select("id", F.xxhash64("term").alias("t"), "weight").collect()
    want = {}
    for r in exploded:
        want.setdefault(r["id"], {})[r["t"]] = r["weight"]
    assert got == want and set(got) == {1, 2, 3}
    assert all(list(r["terms"]) == sorted(r["terms"]) for r in dedupe.counted_rows(df, "id", "text").collect())
    scoped = {r["id"]: r["terms"] for r in dedupe.counted_rows(df, "id", "text", "file").collect()}
    assert scoped[2] != scoped[3] and got[2] == got[3]


@pytest.mark.parametrize("hot_block", [1, 2000])
def test_pairs_in_cells_and_turns_equal_brute_force(spark, monkeypatch, hot_block):
    """Groups below and above FEW rows, blocks of one and of many cells, terms and pairs taken in turns."""
    monkeypatch.setattr(dedupe, "ROW_ENTRIES", 1.9)
    rng = random.Random(9)
    seeds = [[f"s{k}w{j}" for j in range(40)] for k in range(3)]
    docs = [seeds[i % 3] + [f"u{rng.randrange(400)}" for _ in range(rng.randrange(5))] for i in range(120)]
    counts = [Counter(d) for d in docs]
    vectors = spark.createDataFrame([(i, t, float(n)) for i, c in enumerate(counts) for t, n in c.items()], "id long, term string, weight double")
    stages = []

    def cut(df, name):
        stages.append(name)
        return cut_lineage(df, name)

    # Every row begins with the terms of its seed, which 40 rows share.
    sig = spark.createDataFrame([(i, f"s{i % 3}w{j}") for i in range(120) for j in range(2)], "id long, term string")
    got = [tuple(r) for r in dedupe.near_pairs(sig, vectors, 0.96, hot_block, cut).collect()]
    assert sorted(got) == sorted(alike(counts, 0.96)) and len(got) > 1000
    assert stages.count("pairs") > 2 and stages.count("near") > 1


def test_fragments_that_are_no_rows_text_are_not_shuffled(spark):
    rows = spark.createDataFrame([(i, f"a needle of some length, number {i}") for i in range(50)], "id long, text string")
    fragments = rows.select("text").union(spark.range(2000).select(F.concat(F.lit("a fragment of some length, number "), "id")))
    left = [r["text"] for r in dedupe._some_text(fragments, rows).collect()]
    assert {r["text"] for r in rows.collect()} <= set(left) and len(left) < 200
