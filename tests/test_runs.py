"""Runs that write what they find, whole files with sidecars, and saved definitions, against expected rows."""

import hashlib

from pyspark.sql import functions as F

from siltstone.operators import relations, runs
from siltstone.plans import manifests as N
from siltstone.sources import converters
from siltstone.sources.store import Store


def files(path):
    return sorted((str(p.relative_to(path)), p.stat().st_mtime_ns) for p in path.rglob("*") if p.is_file())


def test_extraction_runs_write_changed_chunks_only(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/relations", 4)
    terms = relations.ontology(spark)
    rows = [("c1", "Acme Group acquired Beta Corp. Acme Group acquired Beta Corp."), ("c2", "Nothing here"), ("c3", "Gamma Ltd is based in Berlin."), ("c4", None)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string")
    assert {r.state for r in runs.extraction_run(store, chunks, terms).collect()} == {"new"}
    found = {(r.chunk_id, r.subject, r.predicate, r.object, r.status) for r in store.read("candidates").collect()}
    assert found == {("c1", "Acme Group", "acquired", "Beta Corp", "candidate"), ("c3", "Gamma Ltd", "based_in", "Berlin", "candidate")}
    notes = {r.annotation_id: (r.chunk_id, r.annotation_type, r.extractor) for r in store.read("annotations").collect()}
    assert {r.annotation_id for r in store.read("candidates").collect()} == set(notes) and set(notes.values()) == {("c1", "relation_claim", "rules"), ("c3", "relation_claim", "rules")}
    before = files(tmp_path)
    assert {r.state for r in runs.extraction_run(store, chunks, terms).collect()} == {"unchanged"} and files(tmp_path) == before
    later = spark.createDataFrame([rows[0], ("c2", "Delta Inc uses Cloud Suite."), rows[3]], "chunk_id string, text string")
    assert {r.chunk_id: r.state for r in runs.extraction_run(store, later, terms).collect()} == {"c1": "unchanged", "c2": "changed", "c3": "gone", "c4": "unchanged"}
    assert {(r.chunk_id, r.predicate) for r in store.read("candidates").collect()} == {("c1", "acquired"), ("c2", "uses")}
    assert store.read("annotations").count() == 2 and store.read("documents").count() == 3


def test_an_extractor_of_ones_own_runs_too(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/relations", 2)
    chunks = spark.createDataFrame([(1, "a>b"), (2, "x")], "chunk_id long, text string")
    own = lambda rows: relations.extract_with(rows, lambda text: [(*text.split(">"), "c", 0.5)][:1] if ">" in text else [])
    runs.extraction_run(store, chunks, relations.ontology(spark), own, "arrows")
    assert [(r.chunk_id, r.subject, r.predicate, r.object, r.confidence) for r in store.read("candidates").collect()] == [(1, "a", "b", "c", 0.5)]


def test_a_run_reads_each_text_once_and_writes_a_bucket_in_pieces(spark, tmp_path, monkeypatch):
    """However few files the chunks lie in, and however few buckets there are; kept rows lie beside new ones."""
    monkeypatch.setattr(runs, "PIECE_BYTES", 64, raising=False)
    seen = tmp_path / "seen"

    def arrow(text):
        with seen.open("a") as f:
            f.write(text + "\n")
        return [(*text.split(">"), "c", 0.5)] * 2 if ">" in text else []

    store = Store(spark, f"file://{tmp_path}/relations", 1)
    own = lambda rows: relations.extract_with(rows, arrow)
    texts = {i: f"a{i}>b" if i % 3 else "x" for i in range(60)}
    for _ in range(2):
        chunks = spark.createDataFrame(sorted(texts.items()), "chunk_id long, text string").coalesce(1)
        seen.write_text("")
        states = {r.chunk_id: r.state for r in runs.extraction_run(store, chunks, relations.ontology(spark), own).collect()}
        moved = [texts[i] for i, state in states.items() if state in ("new", "changed")]
        assert sorted(seen.read_text().split()) == sorted(moved)
        claims = sorted((i, *t.split(">")) for i, t in texts.items() if ">" in t)
        for table in ("annotations", "candidates"):
            assert sorted(r.chunk_id for r in store.read(table).collect()) == [i for i, *_ in claims]
            version = store.last_commit()["tables"][table]["versions"]["0"]
            assert len(list((tmp_path / "relations" / table / f"stored_version={version}" / "bucket=0").glob("*.parquet"))) > 1
        assert sorted((r.chunk_id, r.subject, r.predicate) for r in store.read("candidates").collect()) == claims
        assert store.read("documents").count() == len(texts)
        texts = {i: "new>one" if i % 7 == 0 else t for i, t in texts.items() if i % 5 and i < 50} | {99: "y>z"}
    assert {states[i] for i in (7, 5, 99, 1)} == {"changed", "gone", "new", "unchanged"}


def test_relations_are_matched_once_and_by_texts_that_hold_a_verb(spark):
    """Sentences that nearly hold a verb; no filter repeats the patterns, and terms are not dealt by predicate."""
    rows = [(1, "Acme acquired  Beta"), (2, "Acme Acquired Beta"), (3, None), (4, ""), (5, "Acme is owned  by Beta"), (6, "Acme is owned by Beta and Gamma partnered with Delta"), (7, "acquired")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    got = relations.normalize_predicate(relations.extract_relations(chunks), relations.ontology(spark))
    assert sorted((r.chunk_id, r.subject, r.predicate, r.object) for r in got.collect()) == [
        (1, "Acme", "acquired", "Beta"), (6, "Acme", "owned_by", "Beta and Gamma"), (6, "Beta and Gamma", "partners_with", "Delta"),
    ]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "size(flatten" not in plan and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_review_decisions_are_logged(spark):
    items = spark.createDataFrame([(1, 10, "open", {"by": "x", "notes": "old"}), (2, 20, "open", None), (3, 30, "open", {})], "review_id long, candidate_id long, status string, notes map<string,string>")
    decisions = spark.createDataFrame([(1, "resolved", "accept", "fine"), (2, "dismissed", "", None), (2, "resolved", "", ""), (9, "resolved", "", "")], "review_id long, status string, resolution string, notes string")
    after, log = runs.resolve_reviews(items, decisions, "2024-02-10")
    assert {r.review_id: (r.status, r.notes) for r in after.collect()} == {
        1: ("resolved", {"by": "x", "resolution": "accept", "notes": "fine"}), 2: ("resolved", {}), 3: ("open", {}),
    }
    assert sorted((r.review_id, r.candidate_id, r.before, r.after) for r in log.collect()) == [(1, 10, "open", "resolved"), (2, 20, "open", "dismissed"), (2, 20, "open", "resolved")]
    assert log.select("decision_id").distinct().count() == 3


def test_whole_files_with_what_lies_beside_them(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,500\nhello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\nagain\n"
    rows = [
        ("/a/talk.mp3", b"sound", "audio/mpeg"), ("/a/talk.transcript.srt", srt.encode(), "text/plain"), ("/a/talk.txt", b"not the first choice", "text/plain"),
        ("/a/film.mp4", b"film", "video/mp4"), ("/a/film.txt", b"  spoken words \n", "text/plain"), ("/a/mute.wav", b"w", "audio/wav"), ("/a/mute.vtt", b" \n", "text/vtt"),
        ("/a/shot.png", b"png", "image/png"), ("/a/shot.txt", "Überschrift".encode(), "text/plain"), ("/a/alone.png", b"p", "image/png"), ("/a/note.txt", b"A note.", "text/plain"),
    ]
    listing = spark.createDataFrame(rows, "path string, content binary, media_type string")
    wanted = listing.where("path IN ('/a/talk.mp3', '/a/film.mp4', '/a/mute.wav', '/a/shot.png', '/a/alone.png', '/a/note.txt')")
    got = converters.extract_files(wanted, listing).collect()
    by = {}
    for r in got:
        by.setdefault(r.source_ref, []).append(r)
    talk = sorted((r.unit_index, r.unit_type, r.text, r.start, r.end) for r in by["/a/talk.mp3"])
    assert talk == [(1, "audio_transcript_segment", "hello there", 1.0, 2.5), (2, "audio_transcript_segment", "again", 3.0, 4.0)]
    assert {(r.sidecar, r.converter, r.artifact_hash) for r in by["/a/talk.mp3"]} == {("/a/talk.transcript.srt", "audio-transcript-sidecar", hashlib.sha256(b"sound" + srt.encode()).hexdigest())}
    one = lambda ref: by[ref][0]
    assert (one("/a/film.mp4").unit_type, one("/a/film.mp4").text, one("/a/film.mp4").start) == ("video_transcript_segment", "spoken words", None)
    assert (one("/a/shot.png").unit_type, one("/a/shot.png").text, one("/a/shot.png").converter) == ("image_text", "Überschrift", "image-ocr-sidecar")
    assert (one("/a/mute.wav").unit_index, one("/a/mute.wav").error) == (0, "transcript_sidecar_empty")
    assert one("/a/alone.png").text is None and one("/a/alone.png").artifact_hash == hashlib.sha256(b"p").hexdigest()
    assert one("/a/note.txt").text == "A note." and one("/a/note.txt").sidecar is None
    assert set(by) == {r.path for r in wanted.collect()}


def test_definitions_of_metrics_survive_a_save(spark, tmp_path):
    definition = {"canonical_object": "contact", "description": "new leads", "source_priority": ["crm", "ads"], "definition": "stage = 'lead'", "conversions": {"names": ["Lead é"], "weight": 0.5}}
    client = N.Client("a", {"crm": ["mock"]}, {"contact": {"id": "x", "created_at": "y"}}, {"leads": definition, "sqls": {}})
    N.save_clients(spark, [client, N.Client("b", {})], str(tmp_path / "clients"))
    assert N.load_clients(spark, str(tmp_path / "clients")) == [client, N.Client("b", {})]


def test_the_table_function_equals_the_extractor(spark):
    arrows = lambda text: [(a, "to", b, 0.5) for part in text.split(";") if ">" in part for a, b in [part.split(">", 1)]]
    rows = [(1, "x", "a>b;c>d"), (2, "y", ""), (3, "z", None), (4, None, "e>f")]
    chunks = spark.createDataFrame(rows, "chunk_id long, lang string, text string")
    spark.udtf.register("arrow_claims", relations.extractor_function(arrows))
    chunks.createOrReplaceTempView("arrow_chunks")
    got = spark.sql("SELECT * FROM arrow_claims(TABLE(arrow_chunks))")
    assert got.columns == ["chunk_id", "lang", "subject", "predicate", "object", "confidence"]
    want = relations.extract_with(chunks, arrows).select("chunk_id", "subject", "predicate", "object", "confidence")
    assert sorted(map(tuple, got.drop("lang").collect())) == sorted(map(tuple, want.collect()))
    parted = spark.sql("SELECT subject FROM arrow_claims(TABLE(SELECT text, lang FROM arrow_chunks) PARTITION BY lang) WHERE lang = 'x'")
    assert {r.subject for r in parted.collect()} == {"a", "c"}
    try:
        spark.sql("SELECT * FROM arrow_claims(TABLE(SELECT chunk_id FROM arrow_chunks))").collect()
        raise AssertionError("a table without text was taken")
    except Exception as e:
        assert "takes a table with a column text" in str(e)
