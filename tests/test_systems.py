"""Connectors, contracts, exports, file sources and streams."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunking, exports, governance, ledger, relations
from siltstone.plans import manifests as N
from siltstone.sources import connectors as K
from siltstone.sources import converters, media, readers, sinks
from siltstone.streaming import incremental as S

DATA = "/root/testdata/sf0.001"
DAYS = {"start_date": "2024-01-01", "end_date": "2024-01-31"}


def test_manifests_are_valid():
    assert len(N.BUILTIN) == 10 and all(m.errors() == [] for m in N.BUILTIN.values())


@pytest.mark.parametrize(
    "change, word",
    [({"pii_policy": "redacted"}, "personal"), ({"storage_level": "raw"}, "storage"), ({"outputs": ("odd",)}, "metric"), ({"freshness_sla_hours": 0}, "positive"), ({"description": ""}, "description")],
)
def test_manifest_errors(change, word):
    m = N.Manifest(**({"id": "x", "description": "d", "requires": ("crm",), "outputs": ("leads",)} | change))
    assert any(word in e for e in m.errors())


@pytest.mark.parametrize("days, ok", [(DAYS, True), ({"start_date": "2024-02-01", "end_date": "2024-01-01"}, False), ({"start_date": "2024-01-01"}, False), ({"start_date": "x", "end_date": "y"}, False)])
def test_parameters(days, ok):
    assert (N.BUILTIN["pipeline_health"].parameter_errors({"client_id": "c"} | days) == []) == ok


def test_run_collects_errors_and_skips_archived(spark):
    clients = [N.Client("acme", {"crm": ["mock"]}), N.Client("old", {"crm": ["mock"]}, status="archived"), N.Client("bad", {"ads": ["mock"]})]
    mock = {"mock": K.MockSystem(spark, ["acme", "old", "bad"])}
    with pytest.raises(ValueError, match="bad"):
        N.run(N.BUILTIN["pipeline_health"], clients, mock, DAYS)
    rows, failed = N.run(N.BUILTIN["pipeline_health"], clients, mock, DAYS, collect_errors=True)
    assert {r.client_id for r in rows.collect()} == {"acme"} and set(failed) == {"bad"}
    card = N.evidence_cards(N.BUILTIN["pipeline_health"], rows, "2024-02-01 00:00:00").first()
    assert card.evidence_id.startswith("ev:pipeline_health:acme:") and card.quality == "ok"
    text = exports.evidence_source(N.evidence_cards(N.BUILTIN["pipeline_health"], rows, "2024-02-01 00:00:00")).first().markdown
    assert "- leads: 72.0 (source: mock)" in text and "- No conflicts recorded." in text


def test_client_validation():
    client = N.Client("", {"crm": ["nobody"]}, field_map={"contact": {"id": "x"}, "odd": {}}, metrics={"odd": {}}, read_only=False)
    assert len(client.errors({"mock"})) == 6


def test_warehouse_guards(spark):
    spark.range(1000).createOrReplaceTempView("numbers")
    house = K.Warehouse(spark, ("numbers",), max_bytes=100)
    with pytest.raises(K.BudgetExceeded):
        house.rollup("numbers", lambda df: df.groupBy().count())
    with pytest.raises(PermissionError):
        house.read("other")
    with pytest.raises(ValueError):
        house.read("numbers; drop table x")
    assert K.Warehouse(spark, ("numbers",)).rollup("numbers", lambda df: df.groupBy().count()).first()[0] == 1000


def test_paged_source(spark):
    spark.dataSource.register(K.PagedSource)
    df = spark.read.format("siltstone_paged").options(pages=3, page_size=5, fetcher="siltstone.sources.connectors:numbered_rows", schema="id long, name string").load()
    assert sorted(r.id for r in df.collect()) == list(range(15)) and df.rdd.getNumPartitions() == 3


def test_chain_finds_a_changed_payload(spark):
    rows, before = [], ""
    for i in range(1, 6):
        h = [F.sha2(F.lit(f"p{i}"), 256)]
        payload_hash = spark.range(1).select(h[0]).first()[0]
        receipt = spark.range(1).select(governance.receipt(F.lit("t"), F.lit("me"), F.lit(payload_hash), F.lit(before))).first()[0]
        rows.append(("a", i, "t", "me", f"p{i}" if i != 3 else "changed", payload_hash, before, receipt))
        before = receipt
    df = spark.createDataFrame(rows, "chain string, seq int, event_type string, actor string, payload string, payload_hash string, previous_hash string, receipt_hash string")
    bad = governance.verify_chain(df, ["chain"]).where("payload_mismatch or previous_mismatch or receipt_mismatch").collect()
    assert [(r.seq, r.payload_mismatch, r.previous_mismatch) for r in bad] == [(3, True, False)]


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nbody")
    (tmp_path / "b.csv").write_text('k,v\n1,"x, y"\n2,\n')
    (tmp_path / "c.jsonl").write_text('{"a": 1}\nnot json\n')
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "e.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<s xmlns="u"><si><t>name</t></si></s>')
        z.writestr("xl/worksheets/sheet1.xml", '<w xmlns="u"><row><c t="s"><v>0</v></c><c><v>7</v></c></row></w>')
    with zipfile.ZipFile(tmp_path / "f.pptx", "w") as z:
        for i in (10, 2):
            z.writestr(f"ppt/slides/slide{i}.xml", f'<p xmlns:a="u"><a:t>slide {i}</a:t></p>')
    units = converters.convert(converters.scan_files(spark, str(tmp_path)))
    got = {}
    for r in units.orderBy("source_ref", "unit_index").collect():
        got.setdefault(r.source_ref.rsplit("/", 1)[1], []).append((r.unit_type, r.text))
    assert got["a.md"] == [("text", "# T\n\nbody")] and got["d.docx"] == [("document", "Hello there")]
    assert got["b.csv"][1:] == [("table_row", "k: 1; v: x, y"), ("table_row", "k: 2; v: ")]
    assert got["e.xlsx"] == [("sheet", "name\t7")] and got["f.pptx"] == [("slide", "slide 2"), ("slide", "slide 10")]
    assert got["c.jsonl"][0][0] == "text"
    assert sorted(r.row_text for r in readers.read_csv(spark, f"{tmp_path}/b.csv").collect()) == ["k: 1; v: x, y", "k: 2"]
    assert sorted(r.confidence for r in readers.read_json_lines(spark, f"{tmp_path}/c.jsonl").collect()) == ["high", "low"]
    assert readers.read_documents(spark, str(tmp_path)).count() == 1


def test_sidecar_is_the_first_in_order(spark):
    files = spark.createDataFrame([("/a/talk.mp4",), ("/a/b.png",)], "path string")
    listing = spark.createDataFrame([("/a/talk.srt",), ("/a/talk.transcript.vtt",), ("/a/x.txt",)], "path string")
    assert [tuple(r) for r in media.sidecar(files, listing).collect()] == [("/a/talk.mp4", "/a/talk.transcript.vtt")]


def test_stream_windows_equal_batch(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = S.table_stream(spark, f"{tmp_path}/in")
    S.run_to_table(S.signal_windows(stream), f"{tmp_path}/out", f"{tmp_path}/check", "complete")
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("start", "event_type", "n").collect()}
    want = {tuple(r) for r in S.signal_windows(spark.read.parquet(f"{DATA}/events.parquet")).select("start", "event_type", "n").collect()}
    assert got == want and len(want) > 10


def test_stream_index_equals_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", F.lit("plain").alias("strategy"))
    docs.repartition(4).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run has nothing left to do
        S.index_documents(S.table_stream(spark, f"{tmp_path}/in", 1), f"{tmp_path}/index", f"{tmp_path}/check")()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/index").select("chunk_id", "text_hash").collect()}
    want = {tuple(r) for r in chunking.chunk_rows(docs).select("chunk_id", "text_hash").collect()}
    assert got == want and want


def test_stream_drops_repeated_captures(spark, tmp_path):
    rows = [(1, "a", dt.datetime(2024, 1, 1)), (2, "a", dt.datetime(2024, 1, 1, 1)), (3, "b", dt.datetime(2024, 1, 1, 2))]
    spark.createDataFrame(rows, "id long, text string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    S.run_to_table(S.fresh_captures(S.table_stream(spark, f"{tmp_path}/in"), "ts").select("id", "text"), f"{tmp_path}/out", f"{tmp_path}/check")
    assert sorted(r.text for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_stream_reports_stale_sources(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "source_id string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    put("a", [("quiet", day(0)), ("busy", day(0))])
    stream = lambda: S.freshness_alerts(spark.readStream.schema("source_id string, ts timestamp").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"))
    S.run_to_table(stream(), f"{tmp_path}/out", f"{tmp_path}/check")
    put("b", [("busy", day(20))])
    S.run_to_table(stream(), f"{tmp_path}/out", f"{tmp_path}/check")
    put("c", [("busy", day(40))])
    S.run_to_table(stream(), f"{tmp_path}/out", f"{tmp_path}/check")
    put("d", [("busy", day(41))])
    S.run_to_table(stream(), f"{tmp_path}/out", f"{tmp_path}/check")
    got = {(r.source_id, r.status, r.n) for r in spark.read.parquet(f"{tmp_path}/out").groupBy("source_id", "status").agg(F.count("*").alias("n")).collect()}
    assert got == {("quiet", "fresh", 1), ("quiet", "stale", 1), ("busy", "fresh", 4)}


def captures(spark, *rows):
    return spark.createDataFrame([(*r, dt.datetime(2024, 1, 1)) for r in rows], "source_id string, url string, title string, text string, captured_at timestamp")


def test_captures_are_versions_of_their_source(spark, tmp_path):
    root = str(tmp_path / "c")
    new, _ = sinks.capture(captures(spark, ("a", "http://x", None, "# Head\n\nbody"), ("b", "", "t", "other"), ("b", "", "t", "other")), root)
    assert new.count() == 2 and {r.title for r in new.collect()} == {"Head", "t"}
    new, same = sinks.capture(captures(spark, ("a", "http://x", None, "# Head\n\nbody"), ("a", "", "t", "changed"), ("c", "", "t", "other")), root)
    assert {(r.source_id, r.text) for r in new.collect()} == {("a", "changed"), ("c", "other")}
    assert same.count() == 1 and spark.read.parquet(f"{root}/captures").count() == 4


def test_cache_computes_a_body_once(spark, tmp_path):
    seen, path = [], str(tmp_path / "k")

    def compute(df):
        seen.append(df.count())
        return df.select("key", F.upper("body").alias("result"))

    rows = spark.createDataFrame([("x",), ("x",), ("y",)], "body string").withColumn("key", sinks.cache_key(F.col("body"), "m"))
    assert sinks.cached(rows, path, "key", compute).count() == 3
    more = spark.createDataFrame([("x",), ("z",)], "body string").withColumn("key", sinks.cache_key(F.col("body"), "m"))
    assert {(r.body, r.result) for r in sinks.cached(more, path, "key", compute).collect()} == {("x", "X"), ("z", "Z")} and seen == [2, 1]
    assert rows.select(sinks.cache_key(F.col("body"), "n")).intersect(rows.select("key")).count() == 0


def test_cards_are_refreshed_with_their_parameters(spark, tmp_path):
    clients = [N.Client("acme", {"crm": ["mock"]}, field_map={"contact": {"id": "x", "created_at": "y"}}, metrics={"leads": {}}), N.Client("b", {"crm": ["mock"]})]
    N.save_clients(spark, clients, str(tmp_path / "clients"))
    loaded = N.load_clients(spark, str(tmp_path / "clients"))
    assert loaded == clients
    with pytest.raises(ValueError, match="unique"):
        N.save_clients(spark, [clients[0], clients[0]], str(tmp_path / "clients"))
    mock = {"mock": K.MockSystem(spark, ["acme", "b"])}
    rows, _ = N.run(N.BUILTIN["pipeline_health"], loaded, mock, DAYS)
    cards = N.evidence_cards(N.BUILTIN["pipeline_health"], rows, "2024-02-01 00:00:00", parameters=DAYS)
    assert sinks.write_cards(cards, str(tmp_path)).count() == 2 and sinks.write_cards(cards, str(tmp_path)).count() == 0
    stored = spark.read.parquet(str(tmp_path / "cards")).where("client_id = 'acme'")
    again = N.refreshed(stored, loaded, mock, "2024-03-01 00:00:00").first()
    assert again.client_id == "acme" and again.parameters == DAYS and again.evidence_id != stored.first().evidence_id and again.metrics == stored.first().metrics


def test_export_gates(spark):
    conflicts = spark.createDataFrame([("high", "resolved"), ("low", "open"), ("medium", "acknowledged")], "severity string, status string")
    fine = spark.createDataFrame([("a", "ok"), ("b", "warn")], "check_name string, result string")
    governance.require_open_gates(governance.export_gates(conflicts, fine))
    for severity, result, word in (("medium", "error", "open_conflicts"), ("high", "warn", "governance_checks")):
        with pytest.raises(PermissionError, match=word):
            governance.require_open_gates(governance.export_gates(conflicts, fine, severity, result))


def test_appended_events_verify(spark):
    cols = "chain string, seq long, event_type string, actor string, payload string, payload_hash string, previous_hash string, receipt_hash string"
    events = spark.createDataFrame([(c, i, "t", "me", f"{c}{i}") for c in "ab" for i in range(6)], "chain string, at int, event_type string, actor string, payload string")
    old = governance.append_events(spark.createDataFrame([], cols), events.where("at < 4"), "chain", ["at"])
    both = old.unionByName(governance.append_events(old, events.where("at >= 4"), "chain", ["at"]))
    checked = governance.verify_chain(both, ["chain"]).collect()
    assert len(checked) == 12 and {r.seq for r in checked} == set(range(1, 7))
    assert not any(r.payload_mismatch or r.previous_mismatch or r.receipt_mismatch for r in checked)
    one = spark.range(1).select(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("x y")).alias("m"))
    assert one.select(governance.canonical_json(F.col("m"))).first()[0] == '{"a":"x y","b":"1"}'


def test_cursor_pages_tell_when_they_were_cut(spark):
    fetch = lambda cursor, size: ([(int(cursor or 0) * size + i,) for i in range(size)], None if cursor == "3" else str(int(cursor or 0) + 1))
    whole = K.read_cursor(spark, fetch, "n long", page_size=5)
    assert (whole.pages, whole.truncated, whole.rows.count()) == (4, False, 20)
    part = K.read_cursor(spark, fetch, "n long", page_size=5, max_pages=2)
    assert (part.pages, part.truncated) == (2, True) and sorted(r.n for r in part.rows.collect()) == list(range(10))


def test_connectors_are_listed_discovered_and_checked(spark):
    assert set(K.available()) == {"tables", "ads", "analytics", "warehouse", "mock"}
    spark.range(3).createOrReplaceTempView("numbers")
    assert K.discover(spark, ("numbers", "absent")) == [("numbers", "id", "bigint")]
    ads = K.AdsTable(spark.createDataFrame([("c1", 5)], "client_id string, clicks long"))
    assert [(n, ok) for n, ok, _ in K.setup_checks(ads, ["c1"])] == [("kind", True), ("rows.client_id", True)]
    assert not dict((n, ok) for n, ok, _ in K.setup_checks(ads, ["c1"], live=True))["live"]
    assert dict((n, ok) for n, ok, _ in K.setup_checks(K.MockSystem(spark, ["c1"]), ["c1"], live=True))["live"]


def test_seeds_and_checked_folders(spark, tmp_path):
    import hashlib

    (tmp_path / "seed.json").write_text('{"sources": [{"id": "a", "score": 3},\n {"id": "b", "score": 4}], "other": [1]}')
    seed = readers.read_seed(spark, str(tmp_path / "seed.json"), {"sources": "id:string,score:int", "claims": "id:string"})
    assert sorted(map(tuple, seed["sources"].collect())) == [("a", 3), ("b", 4)] and seed["claims"].count() == 0
    folder = tmp_path / "set"
    folder.mkdir()
    (folder / "a.csv").write_text("x\n1\n")
    (folder / "b.csv").write_text("changed")
    good = hashlib.sha256(b"x\n1\n").hexdigest()
    manifest = spark.createDataFrame([("a.csv", good.upper()), ("b.csv", good), ("c.csv", good)], "path string, sha256 string")
    got = {r.path: r.problem for r in readers.read_checked(spark, str(folder), manifest).collect()}
    assert got == {"a.csv": None, "b.csv": "changed", "c.csv": "missing"}


def test_sidecars_are_never_broadcast(spark, tmp_path):
    """Stored names look small and are not: a listing that grows with the folders must not go through the driver."""
    spark.range(1000).selectExpr("id AS p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    from siltstone.plans.registry import QUERIES

    found = QUERIES["A16_sidecars"](spark, str(tmp_path))
    assert found.count() == sum(k % 4 == 0 or k % 6 == 0 or k % 10 == 0 for k in range(1000))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_sidecars_stand_for_media_and_pdf_without_reader_is_an_error(spark):
    png, pdf = "image/png", "application/pdf"
    files = spark.createDataFrame(
        [("/m/a.png", b"..", png), ("/m/a.txt", b" words \n", "text/plain"), ("/m/b.png", b"..", png), ("/m/c.pdf", b"%PDF", pdf)], "path string, content binary, media_type string"
    )
    assert [tuple(r) for r in converters.sidecar_units(files).collect()] == [("/m/a.png", "/m/a.txt", "sidecar", "words")]
    assert converters.convert(files.where("path = '/m/c.pdf'")).first().error


def test_extractors_and_rewritten_aliases(spark):
    chunks = spark.createDataFrame([(1, "Acme bought Beta"), (2, None)], "chunk_id long, text string")
    got = relations.extract_with(chunks, lambda text: [("Acme Inc", "acquired", "Beta", 0.9)] if "bought" in text else [])
    assert [(r.chunk_id, r.subject, r.confidence) for r in got.collect()] == [(1, "Acme Inc", 0.9)]
    nodes = "id string, name string, status string"
    state = {"nodes": spark.createDataFrame([("a", "A", "active"), ("b", "B", "active")], nodes)}
    state |= {k: spark.createDataFrame([("a", "old"), ("b", "kept")], f"node_id string, {c} string") for k, c in (("aliases", "alias"), ("tags", "tag"))}
    new = {"nodes": spark.createDataFrame([("a", "A2", "active")], nodes), "aliases": spark.createDataFrame([("a", "new"), ("z", "stray")], "node_id string, alias string")}
    out = ledger.upsert_nodes(state, new)
    assert {tuple(r) for r in out["aliases"].collect()} == {("a", "new"), ("b", "kept")} and {tuple(r) for r in out["tags"].collect()} == {("b", "kept")}
    assert {tuple(r)[:2] for r in out["nodes"].collect()} == {("a", "A2"), ("b", "B")}
