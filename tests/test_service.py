import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from deskbook.operators import access, billing, corpus, feedback, retrieval, threads
from deskbook.streaming import jobs


def test_multiplier_formula(spark):
    rows = [(1.5, 10, 8, 0, 0.706), (4.7, 10, 0, 8, 1.2), (3.0, 5, 0, 0, 1.0), (5.0, 1, 0, 1, 1.014), (0.0, 0, 0, 0, 1.0)]
    got = spark.createDataFrame(rows, "a double, n int, low int, high int, want double").select("want", feedback.retrieval_multiplier(F.col("a"), F.col("n"), F.col("low"), F.col("high")).alias("m")).collect()
    assert all(abs(r.want - r.m) < 1e-9 for r in got)


def test_feedback_reaches_cited_chunks_once(spark):
    cited = spark.createDataFrame([("m1", "t1", "c1", "d1", 1), ("m1", "t1", "c1", "d1", 1), ("m1", "t1", "c2", "d2", 1)], "message_id string, thread_id string, chunk_id string, doc_id string, created_ts long")
    log = spark.createDataFrame([(1, "m1", 7, 5, " ", datetime(2024, 1, 1)), (2, "m1", 7, 1, "bad", datetime(2024, 1, 2)), (3, "m1", 8, 6, None, datetime(2024, 1, 1))], "event_id long, message_id string, user_id long, rating int, comment string, ts timestamp")
    latest = feedback.latest_feedback(log, "message_id")
    assert [(r.rating, r.comment) for r in latest.collect()] == [(1, "bad")]
    none = spark.createDataFrame([], "event_id long, thread_id string, user_id long, rating int, ts timestamp")
    signals = feedback.ranking_signals(cited, latest, none).collect()
    assert {(s.chunk_id, s.rating_count) for s in signals} == {("c1", 1), ("c2", 1)} and all(s.multiplier < 1 for s in signals)
    pending = spark.createDataFrame([], "message_id string, status string")
    assert feedback.queue_candidates(latest, "message_id", pending).count() == 0
    assert feedback.queue_candidates(log.where("rating = 5"), "message_id", pending).count() == 1


def test_settlement(spark):
    requests = spark.createDataFrame([(1, 1, 0, 20, 12), (2, 1, 1, 20, None), (3, 1, 2, 20, 30)], "request_id long, user_id long, ts long, reserved_cents long, actual_cents long")
    assert {(r.request_id, r.kind, r.amount_cents) for r in billing.settle(requests).collect()} == {(1, "debit", 12), (1, "release", 8), (3, "debit", 20)}
    grants = spark.createDataFrame([(1, 20)], "user_id long, amount_cents long")
    assert [(r.accepted, r.balance_after) for r in billing.replay_admissions(requests, grants).orderBy("request_id").collect()] == [(True, 8), (False, 8), (False, 8)]
    assert [(r.request_id, r.open_cents) for r in billing.open_reservations(billing.ledger(requests, grants)).collect()] == [(2, 20)]


def test_prices(spark):
    want = {
        "openai:gpt-5-mini": "gpt-5-mini", "openai:gpt-5.2-2026-01-01": "gpt-5.2", "anthropic:claude-opus-4-6-20991231": "claude-opus-4-6", "anthropic:claude-3-opus-latest": "claude-3-opus",
        "gemini:gemini-2.5-flash-preview-01-02": "gemini-2.5-flash", "gemini:gemini-2.0-flash-001": "gemini-2.0-flash", "gemini:gemini-exp-1206": None, "anthropic:claude-opus-4-5": None,
        "openai:unknown": None, "nobody:gpt-5": None, "gemini:gemini-pro-latest": None,
    }
    got = {r.model_id: r.family for r in billing.resolve_prices(spark.createDataFrame([(k,) for k in want], "model_id string")).collect()}
    assert got == want
    turns = spark.createDataFrame([("gemini:gemini-2.5-pro", 200_000.0, 0.0), ("gemini:gemini-2.5-pro", 200_001.0, 0.0), ("x", 5.0, 5.0)], "model_id string, input_tokens double, output_tokens double")
    assert sorted((r.tier, r.cost_cents) for r in billing.turn_costs(turns).collect()) == [("long-context", 51), ("standard", 25), ("unknown", 0)]
    assert spark.range(1).select(billing.usd_to_cents(F.lit(0.07))).first()[0] == 8


def test_login(spark):
    now = datetime(2024, 1, 1)
    attempts = spark.createDataFrame([(1, "a@home.org", True), (2, "b@x.org", True), (3, "c@x.org", False), (4, "d@x.org", True), (5, "e@x.org", True), (6, None, True), (7, "f@x.org", True)], "id long, email string, email_verified boolean")
    users = spark.createDataFrame([("e@x.org", "active"), ("f@x.org", "disabled")], "email string, status string")
    invites = spark.createDataFrame([(1, " B@x.org", "pending", now, now + timedelta(days=1)), (2, "d@x.org", "pending", now, now)], "invite_id long, email string, status string, created_at timestamp, expires_at timestamp")
    got = {r.id: r.reason for r in access.login_decisions(attempts, users, invites, F.lit(now), "home.org").collect()}
    assert got == {1: None, 2: None, 3: "unverified_email", 4: "invite_required", 5: None, 6: "missing_email", 7: "disabled_user"}


def chunks(spark):
    return spark.createDataFrame(
        [("c1", "d1", "https://support.example.com/a", "Portal login help", "Login", "Use the portal to login", "support", 1), ("c2", "d2", "https://dev.example.com/a", "Developer login guide", "Login", "OAuth login for developers", "dev", 2)],
        "chunk_id string, doc_id string, url string, title string, section string, text string, source string, ord long",
    )


def test_retrieval_source_filter(spark):
    own, asked = chunks(spark), spark.createDataFrame([(1, "login")], "query_id long, query string")
    find = lambda sources: {r.chunk_id for r in retrieval.bm25_scores(asked, own, sources).collect()}
    assert find(["support"]) == {"c1"} and find(["dev"]) == {"c2"} and find(None) == {"c1", "c2"} and find([]) == set()


def test_diversity_backfills(spark):
    rows = [(1, "c1", "u1", 5.0), (1, "c2", "u1", 4.0), (1, "c3", "u2", 1.0), (1, "c4", "u1", 3.0)]
    got = retrieval.diverse_top_k(spark.createDataFrame(rows, "query_id long, chunk_id string, url string, score double"), 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c1", "c3", "c2"]


def test_context_window_takes_the_oldest(spark):
    rows = [("t", f"m{i:03}", i, "user" if i % 2 else "assistant") for i in range(40)]
    messages = spark.createDataFrame(rows, "thread_id string, message_id string, created_ts long, role string")
    assert [r.created_ts for r in threads.context_window(messages).orderBy("created_ts").collect()] == list(range(12, 24))
    assert [r.created_ts for r in threads.context_window(messages, recent=True).orderBy("created_ts").collect()] == list(range(28, 40))


def corpus_of_words(spark, n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7))) for _ in range(400)]
    pick = lambda k: " ".join(rng.choices(words, weights=[1 / i for i in range(1, 401)], k=k))
    rows = [(f"c{i:05}", f"d{i}", f"https://h/{i % (n // 2 + 1)}", pick(3), None, pick(rng.randint(0, 60)), "s", i) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, url string, title string, section string, text string, source string, ord long"), [pick(rng.randint(1, 5)) for _ in range(30)]


def best_of_all(queries, index, k):
    scores = retrieval.bm25_scores(queries, index).join(index.lists.select("chunk_id", "url"), "chunk_id")
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in retrieval.diverse_top_k(scores, k).collect())


def test_local_top_k_is_that_of_all_pairs(spark, monkeypatch):
    own, asked = corpus_of_words(spark, 1500)
    queries = spark.createDataFrame([(i, q) for i, q in enumerate([*asked, "", "zzzzz", "the"])], "query_id long, query string")
    index = retrieval.build_index(own)
    found = lambda: sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in retrieval.top_chunks(queries, index, 4).collect())
    want = best_of_all(queries, index, 4)
    assert found() == want and len(want) > 100
    ((block, _),) = retrieval._blocks(queries, index)
    kept, all_pairs = retrieval.pair_scores(index.lists.coalesce(2), block, 4).count(), retrieval.pair_scores(index.lists, block).count()
    assert kept < all_pairs / 2  # one- and two-word queries may be phrases anywhere
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(retrieval, "CELLS", 500)
    monkeypatch.setattr(retrieval, "HELD", 3)
    assert found() == want


def test_extended_index_is_a_new_one(spark):
    own, asked = corpus_of_words(spark, 400)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    index = retrieval.extend_index(retrieval.build_index(own.where("ord < 300")), own.where("ord >= 250"), own.where("ord % 7 = 0 and ord < 200").select("chunk_id"))
    index = retrieval.compact_index(retrieval.extend_index(index, own.where("ord = 7")))
    whole = retrieval.build_index(own.where("ord % 7 > 0 or ord >= 200 or ord = 7"))
    assert best_of_all(queries, index, 5) == best_of_all(queries, whole, 5)
    assert sorted(map(tuple, index.df.collect())) == sorted(map(tuple, whole.df.collect())) and index.stats.first() == whole.stats.first()
    none = retrieval.extend_index(index, own.limit(0), own.select("chunk_id"))
    assert none.stats.first().n == 0 and none.df.count() == 0 and retrieval.top_chunks(queries, none, 3).count() == 0


def test_rate_limit_batch_and_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("test", 1, start, 1), ("test", 1, start, 2), ("test", 1, start, 3), ("test", 1, start + timedelta(seconds=60), 4), ("test", 2, start, 5)]
    events = spark.createDataFrame(rows, "scope string, k long, ts timestamp, event_id long")
    batch = {tuple(r) for r in jobs.rate_limit(events, 2, 60_000).collect()}
    assert {r[2]: r[5] for r in batch} == {1: True, 2: True, 3: False, 4: True, 5: True}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_rate_limit(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 2, 60_000)
    query = stream.writeStream.format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(once=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("limits").collect()} == batch


def test_wallet_stream(spark, tmp_path):
    rows = [(1, 0, 0, "grant", 20, -1), (1, 1, 1, "reservation", 50, -1), (1, 2, 2, "reservation", 20, 12)]
    entries = spark.createDataFrame(rows, "user_id long, ts long, request_id long, kind string, amount_cents long, actual_cents long")
    entries.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.stream_admissions(spark.readStream.schema(entries.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("wallets").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("wallets").collect()} == {(1, 1, False, 20), (2, 1, True, 8)}


def test_hot_keys_pass_in_bounded_memory(spark, tmp_path):
    n = 120_000
    rows = spark.range(n).selectExpr("'all' as scope", "1L as k", "timestamp_millis(id) as ts", "id as event_id").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    query = jobs.stream_rate_limit(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 5, n).writeStream.format("memory").queryName("hot").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(once=True).start()
    query.awaitTermination()
    found = spark.table("hot").agg(F.count("*"), F.count_if("allowed"), F.max("n"), F.countDistinct("event_id")).first()
    assert tuple(found) == (n, 5, n, n)


def test_late_rows_of_streams(spark, tmp_path):
    schema = "user_id long, ts long, request_id long, kind string, amount_cents long, actual_cents long"
    for i, rows in enumerate([[(1, 5, 1, "reservation", 10, -1)], [(1, 0, 0, "grant", 20, -1), (1, 9, 3, "reservation", 15, 12)], [(1, 7, 2, "reservation", 8, -1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        query = jobs.stream_admissions(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 1, False, 0), (3, 1, True, 8), (2, 1, True, 0)}


def test_running_balance_of_one_user(spark):
    rng = random.Random(4)
    rows = [(7 if i % 2 else i % 9, i // 3, None if i % 5 == 0 else i // 7, rng.choice(["grant", "reservation", "debit", "release"]), rng.randint(1, 99)) for i in range(900)] + [(None, 1, 1, "grant", 5), (None, 2, 1, "reservation", 3)]
    df = spark.createDataFrame(rows, "user_id long, ts long, request_id long, kind string, amount_cents long")
    kinds = ("grant", "reservation", "debit", "release")
    want, sums = [], {}
    for u, ts, request, kind, cents in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], -1 if r[2] is None else r[2], kinds.index(r[3]), r[4])):
        sums[u] = sums.get(u, 0) + (cents if kind in ("grant", "release") else -cents if kind == "reservation" else 0)
        want.append((u, ts, request, kind, cents, sums[u]))
    assert sorted(map(tuple, billing.running_balance(df).collect()), key=str) == sorted(want, key=str)
    assert billing.running_balance(df.limit(0)).count() == 0


def test_signals_are_folded_batch_by_batch(spark, tmp_path):
    cited = spark.createDataFrame([(f"m{i}", f"t{i % 3}", f"c{(i * j) % 5}", f"d{i}", i) for i in range(8) for j in (1, 2, 2)], "message_id string, thread_id string, chunk_id string, doc_id string, created_ts long")
    rng = random.Random(2)
    schema = "event_id long, message_id string, thread_id string, user_id long, rating int, comment string, ts timestamp"
    log = [(i, f"m{rng.randrange(9)}" if i % 3 else None, None if i % 3 else f"t{rng.randrange(4)}", rng.randrange(3), rng.randint(0, 6), " ", datetime(2024, 1, 1 + rng.randrange(4))) for i in range(80)]
    latest = lambda key: spark.createDataFrame([], f"{key} string, user_id long, rating int, ts timestamp, event_id long")
    state = {"message_id": latest("message_id"), "thread_id": latest("thread_id"), "stats": spark.createDataFrame([], "chunk_id string, n long, total long, low long, high long"), "signals": {}}

    def write(messages, threads, sums, signals, epoch):
        for key, rows in (("message_id", messages), ("thread_id", threads)):
            state[key] = spark.createDataFrame(feedback.with_newer(state[key], rows, key).collect(), state[key].schema)
        ids = {r.chunk_id for r in sums.collect()}
        old = [r for r in state["stats"].collect() if r.chunk_id not in ids]
        state["stats"] = spark.createDataFrame(old + sums.collect(), state["stats"].schema)
        state["signals"] = {k: v for k, v in state["signals"].items() if k not in ids} | {r.chunk_id: tuple(r) for r in signals.collect()}
        state["touched"] = ids

    handle = jobs.signal_updater(lambda: (state["message_id"], state["thread_id"], state["stats"]), cited, write)
    rng.shuffle(log)
    for epoch, part in enumerate((log[:30], log[30:60], log[20:50], log[60:])):  # the third comes again
        handle(spark.createDataFrame(part, schema), epoch)
        if epoch == 2:
            assert state["touched"] == set()
    whole = spark.createDataFrame(log, schema)
    by = lambda key: feedback.latest_feedback(whole.where(F.col(key).isNotNull()), key)
    assert state["signals"] == {r.chunk_id: tuple(r) for r in feedback.ranking_signals(cited, by("message_id"), by("thread_id")).collect()}
    assert len(state["signals"]) > 2
    log_of_messages = spark.createDataFrame([(999, "m1", 1, 5, None, datetime(2025, 1, 1))], "event_id long, message_id string, user_id long, rating int, comment string, ts timestamp")
    log_of_messages.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.readStream.schema(log_of_messages.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert state["touched"] and state["message_id"].where("event_id = 999").count() == 1


def test_page_ingestion(spark, tmp_path):
    page = lambda i, words: (i, f"https://h.example.com/p{i}", f"<h1>Page {i}</h1><article>{words * 60}</article>")
    schema = "page_id long, url string, html string"
    pages = spark.createDataFrame([page(1, "first words "), page(2, "other words "), (3, "https://h.example.com/p3", "Access denied"), (4, "https://h.example.com/p4", "<p>nothing</p>")], schema)
    pages.coalesce(1).write.parquet(str(tmp_path / "in"))
    stored = {"articles": corpus.extract_articles(pages.limit(0)).drop("page_id", "error"), "cache": spark.createDataFrame([], "url string, content_hash string")}
    chunks = {}

    def write(merged, fresh, epoch):
        merged.write.parquet(str(tmp_path / f"articles{epoch}"))
        chunks[epoch] = sorted((r.doc_id, r.chunk_id) for r in fresh.collect())
        stored["articles"] = spark.read.parquet(str(tmp_path / f"articles{epoch}"))
        stored["cache"] = stored["articles"].select("url", "content_hash")

    handle = jobs.page_ingester(spark, lambda: (stored["articles"], stored["cache"]), write)
    spark.readStream.schema(schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert stored["articles"].count() == 2 and len(chunks[0]) == 2
    handle(spark.createDataFrame([page(1, "first words "), page(2, "changed words ")], schema), 1)
    assert stored["articles"].count() == 2 and len(chunks[1]) == 1 and stored["articles"].where("body_markdown like '%changed%'").count() == 1


def test_stored_corpus_rewrites_its_own_buckets(spark, tmp_path):
    path, out = str(tmp_path / "corpus"), {}
    page = lambda i, words="some words ": (i, f"https://h.example.com/p{i}", f"<h1>Page {i}</h1><article>{words * 60}</article>")
    frame = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")
    files = lambda: {str(f.relative_to(tmp_path)) for f in (tmp_path / "corpus").rglob("*.parquet")}

    def write(outcomes, chunks, epoch):
        out[epoch] = ({r.url[-2:]: r.outcome for r in outcomes.collect()}, len({r.doc_id for r in chunks.collect()}))

    handle = jobs.store_ingester(spark, path, write, 16)
    handle(frame([page(i) for i in range(10, 40)]), 0)
    first = files()
    assert set(out[0][0].values()) == {"new"} and out[0][1] == 30 and len(first) > 8
    handle(frame([page(10), page(11, "other words "), (12, "https://h.example.com/zz", "<p>nothing</p>")]), 1)
    assert out[1] == ({"10": "unchanged", "11": "updated", "zz": "failed"}, 1)
    assert len(first - files()) == 1 and len(files()) == len(first)  # one bucket's file was replaced
    second = files()
    handle(frame([page(11, "other words "), page(10)]), 2)
    assert out[2] == ({"11": "unchanged", "10": "unchanged"}, 0) and files() == second
    rows = spark.read.parquet(path)
    assert rows.count() == 30 and rows.where("body_markdown like '%other%'").count() == 1


def test_prompt_sizes(spark):
    rows = [("a", "m", 2, "x2", "hi  "), ("a", None, 1, "x1", " yo "), ("a", None, 3, "x3", " "), ("b", None, 1, "y1", "\n"), ("c", "n", 1, "z", "é")]
    got = {r.thread_id: (r.model_id, r.prompt_chars) for r in threads.prompt_sizes(spark.createDataFrame(rows, "thread_id string, model_id string, created_ts long, message_id string, content string"), "Do:").collect()}
    assert got == {"a": ("m", len("Do:\n yo \nhi")), "b": (None, 3), "c": ("n", 5)}
