"""Values of single operators, on small inputs."""

import pytest
from pyspark.sql import functions as F

from quire.functions import scores as S
from quire.functions import text as X
from quire.operators import batches, jobs, layout, sections, translate
from quire.settings import Settings


def one(spark, make, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'double' if isinstance(values[n], float) else 'string'}" for n in names))
    return df.select(make(*[F.col(n) for n in names]).alias("x")).first().x


@pytest.mark.parametrize("text", ["Le texte est traduit. Who", "Le texte. What", "Le texte. If", "Un outil AI-powered", "Les Technology Startups"])
def test_residual_found(spark, text):
    assert one(spark, X.has_residual, t=text)


@pytest.mark.parametrize("text", ["Emma marche avec Shadow.", "David Grey arrive demain.", "Le modele AI lit un PDF CEFR."])
def test_residual_not_found(spark, text):
    assert not one(spark, X.has_residual, t=text)


@pytest.mark.parametrize("text,clean", [
    ("Le contenu est traduit. From", "Le contenu est traduit."), ("However, le sujet continue.", "However, le sujet continue."), ("Une ligne, however issues", "Une ligne"), ("", ""),
])
def test_clean_artifacts(spark, text, clean):
    assert one(spark, X.clean_artifacts, t=text) == clean


def test_paragraph_suffix(spark):
    source = "Scientists say human activity. However climate over developing while it."
    got = one(spark, X.clean_paragraph, s=source, t="Les enjeux environnementaux. Scientists Human Over However While Climate It Developing")
    assert got == "Les enjeux environnementaux."
    assert one(spark, X.clean_paragraph, s="The Paris Agreement", t="Le document cite Paris Agreement.") == "Le document cite Paris Agreement."


@pytest.mark.parametrize("source,text,clean", [
    ("Faster detection", "Detection plus rapide Faster", "Detection plus rapide"), ("PDF format", "Format PDF", "Format PDF"), ("Data", "Data", "Data"), ("Job losses", "", ""),
])
def test_table_cell(spark, source, text, clean):
    assert one(spark, X.clean_cell, s=source, t=text) == clean


def test_acronym_pair(spark):
    assert one(spark, X.acronym_pair, a="AI", b="Artificial Intelligence")
    assert one(spark, X.join_texts, a="AI", b="Artificial Intelligence") == "Artificial Intelligence (AI)"
    assert one(spark, X.join_texts, a="environ-", b="ment sain") == "environment sain"


@pytest.mark.parametrize("text", ["AI-powered", "However Issues", "Technology Startups", "Learning"])
def test_noise(spark, text):
    assert one(spark, lambda t: X.is_noise(t, F.lit("paragraph"), F.lit(11.0)), t=text)


def test_not_noise(spark):
    assert not one(spark, lambda t: X.is_noise(t, F.lit("paragraph"), F.lit(11.0)), t="David Grey")
    assert not one(spark, lambda t: X.is_noise(t, F.lit("title"), F.lit(16.0)), t="Overview")


def test_similarity(spark):
    assert one(spark, X.text_similarity, a="page 3 of 9", b="Page 4 of 9") == 1.0
    assert one(spark, X.text_similarity, a="", b="x") == 0.0
    assert 0.5 < one(spark, X.text_similarity, a="the quick brown fox", b="the quick brown ox") < 1.0


def confidence(spark, kind, source, translated, size=11.0, n=1):
    make = lambda s, t: S.semantic_confidence(F.lit(kind), S.Texts.of(s, t), F.lit(size), F.lit(""), F.lit(n), F.lit(False), F.lit(False))["score"]
    return one(spark, make, s=source, t=translated)


def test_semantic_confidence(spark):
    assert confidence(spark, "paragraph", "This agreement defines the responsibilities of each party.", "Ce contrat definit les responsabilites de chaque partie.") >= 0.75
    assert confidence(spark, "title", "Ethical AI Governance", "Gouvernance ethique", 16.0) >= 0.75
    assert confidence(spark, "paragraph", "AI", "IA") < 0.45
    assert confidence(spark, "paragraph", "However", "Cependant") < 0.45
    assert confidence(spark, "paragraph", "Governments", "Gouvernements", n=2) < 0.45


def test_scores_of_empty_texts(spark):
    for make in (lambda s, t: S.translation_quality(F.lit("paragraph"), S.Texts.of(s, t)), lambda s, t: S.english_residual(F.lit("paragraph"), S.Texts.of(s, t))):
        assert one(spark, make, s="x", t="") == 0.0


def test_sections(spark):
    rows = [(1, 1, 0, "paragraph", "lead"), (1, 1, 1, "title", "A"), (1, 1, 2, "paragraph", "x"), (1, 2, 5, "title", ""), (1, 2, 6, "noise", "n"), (1, 2, 7, "list_item", "- y")]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, pos int, type string, source_text string")
    got = [(r.section_id, r.title, r.page_start, r.page_end, r.block_ids) for r in sections.sections(df).orderBy("section_id").collect()]
    assert got == [("section_001", "Untitled section", 1, 1, "0"), ("section_002", "A", 1, 1, "1,2"), ("section_003", "Untitled section", 2, 2, "5,7")]


def test_page_batches(spark):
    got = batches.page_batches(spark.createDataFrame([(1, 12), (2, 0)], "doc_id long, page_count int")).orderBy("page_start").collect()
    assert [(r.batch_id, r.page_start, r.page_end) for r in got] == [("batch_001", 1, 5), ("batch_002", 6, 10), ("batch_003", 11, 12)]
    with pytest.raises(ValueError):
        batches.page_batches(spark.range(1), 0)


def test_line_merge(spark):
    rows = [(1, 1, 0, "paragraph", "first part", 11.0, 72.0, 100.0, 300.0, 112.0), (1, 1, 1, "paragraph", "second", 11.0, 73.0, 116.0, 310.0, 128.0), (1, 1, 2, "paragraph", "far", 11.0, 72.0, 300.0, 310.0, 312.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, pos int, type string, source_text string, size double, x0 double, y0 double, x1 double, y1 double")
    got = layout.merged_lines(df).orderBy("pos").collect()
    assert [(r.source_text, r.lines, r.y1) for r in got] == [("first part second", 2, 128.0), ("far", 1, 312.0)]


def test_duplicates(spark):
    rows = [(1, 1, 0, 0, "same words here", 72.0, 100.0, 300.0, 112.0), (1, 1, 0, 1, "same words here", 72.2, 100.2, 300.2, 112.2), (1, 1, 1, 0, "quite another text", 72.0, 100.0, 300.0, 112.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_number int, pos int, copy int, source_text string, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.pos, r.copy) for r in layout.deduplicated(df.withColumn("type", F.lit("paragraph"))).collect()) == [(0, 0), (1, 0)]


def test_provider_retries_and_falls_back(spark):
    def client(text):
        raise RuntimeError("429 slow down" if text == "limit" else "boom")

    df = spark.createDataFrame([("limit",), ("x",)], "t string")
    got = [r.r for r in df.select(translate.called(client, fallback=lambda t: f"[{t}]")("t").alias("r")).collect()]
    assert got[0].code == "RATE_LIMITED" and got[1].text == "[x]"
    assert translate.parse_reply('{"translated_text": " oui "}') == "oui"


def test_job_run_tells_states():
    told = []
    assert jobs.run("d", {}, told.append) and [t["progress"] for t in told] == [20, 60, 80, 90, 100]
    told.clear()
    assert not jobs.run("d", {"extraction": lambda: 1 / 0}, told.append)
    assert told[-1]["status"] == "failed" and told[-1]["progress"] == 0 and told[-1]["error"]["code"] == "ZeroDivisionError"


def test_span_source(spark, tmp_path):
    import json

    from quire.sources.spans import register

    for page in (1, 2, 3):
        (tmp_path / f"{page}.jsonl").write_text(json.dumps({"document_id": "d", "page_number": page, "page_width": 595.0, "page_height": 842.0, "block_no": 0, "line_no": 0, "span_no": 0,
            "text": f"Page text {page} here now", "font": "Times-Bold", "size": 11.0, "flags": 16, "color": 255, "x0": 72.0, "y0": 100.0, "x1": 200.0, "y1": 112.0}) + "\n")
    register(spark)
    spans = spark.read.format("page_spans").load(str(tmp_path)).where("page_number >= 2")
    got = layout.typed_lines(layout.span_lines(spans)).orderBy("page_number").collect()
    assert [(r.page_number, r.source_text, r.bold, r.color) for r in got] == [(2, "Page text 2 here now", True, "#0000ff"), (3, "Page text 3 here now", True, "#0000ff")]


def test_admission(spark):
    from quire.sources.spans import admission

    rows = [("a.PDF", "application/pdf", 10, b"%PDF-1"), ("a.txt", "application/pdf", 10, b"%PDF"), ("b.pdf", "application/pdf", 11 << 20, b"%PDF"), ("c.pdf", "application/pdf", 0, b"")]
    got = admission(spark.createDataFrame(rows, "path string, mime string, length long, content binary"), Settings()).collect()
    assert [(r.code, r.http_status) for r in got] == [(None, None), ("INVALID_FILE_TYPE", 400), ("FILE_TOO_LARGE", 413), ("INVALID_FILE_TYPE", 400)]


def test_stream_equals_batch(spark, tmp_path):
    from quire.streaming.jobs import read_events, status_windows, transitions

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).sortWithinPartitions("ts", "event_id").write.parquet(str(tmp_path / "in"))
    stream = transitions(read_events(spark, str(tmp_path / "in"), events.schema))
    q = stream.writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("moves").count() == events.count()
    first = spark.table("moves").where("before = 'processing' AND requested = 'queued'")
    assert first.where("code IS NULL").isEmpty()
    q = status_windows(read_events(spark, str(tmp_path / "in"), events.schema)).writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "w")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").agg(F.sum("n")).first()[0] == events.count()


# Tables by running means.


def _grid(rows, xs, y0=100.0, step=24.0, width=lambda t: max(24.0, 7.0 * len(t)), drop=()):
    return [
        (1, 1, 10 * i + j, "unknown", t, xs[j], y0 + step * i, xs[j] + width(t), y0 + step * i + 14)
        for i, row in enumerate(rows) for j, t in enumerate(row) if (i, j) not in drop
    ]


_BLOCK = "doc_id long, page_number int, pos int, type string, source_text string, x0 double, y0 double, x1 double, y1 double"
_ROWS = [["Item", "Q1", "Q2", "Q3"], ["Sales", "12", "15", "19"], ["Costs", "37", "41", "44"]]


def test_table_regions(spark):
    from quire.operators import regions

    make = lambda rows: regions.table_cells(spark.createDataFrame(rows, _BLOCK))
    full = make(_grid(_ROWS, [72.0, 160.0, 250.0, 360.0]))
    t = regions.table_blocks(full).collect()
    assert [(r.n_rows, r.n_columns, r.n_cells, r.confidence) for r in t] == [(3, 4, 12, 1.0)]
    q = regions.table_quality(full).first()
    assert q.score >= 0.9 and (q.cells, q.open_cells, q.is_weak) == (12, 12, False)
    # a cell whose row still has three of four aligned ones: runs need rows of equal width, so the row opens a new run
    lines = [*_ROWS, ["Taxes", "1", "2", "3"], ["Total", "7", "8", "9"]]
    cells = make(_grid(lines, [72.0, 160.0, 250.0, 360.0], drop={(2, 2)}) + [(1, 1, 99, "paragraph", "A longer paragraph that is no cell of any table here", 72.0, 60.0, 400.0, 74.0)])
    assert {(r.n_rows, r.n_columns) for r in regions.table_blocks(cells).collect()} == {(2, 4)}
    assert make(_grid([["a", "b"], ["c"]], [72.0, 160.0])).count() == 0 and make([]).count() == 0
    assert make([(1, 1, 0, "unknown", None, 72.0, 1.0, 90.0, 14.0), (1, 1, 1, "header", "x", 72.0, 1.0, 90.0, 14.0)]).count() == 0


def test_clusters_follow_running_means(spark):
    from quire.operators.regions import Cell, bands, matrix, row_clusters, sureness

    cells = [Cell(k, str(k), 72.0, 100.0 + 24 * k, 110.0, 114.0 + 24 * k) for k in range(3)] + [Cell(9 + k, "x", 160.0 + 4 * k, 101.0 + 24 * k, 200.0, 115.0 + 24 * k) for k in range(2)]
    assert [len(own) for _, _, own in row_clusters(cells)] == [2, 2, 1] and [(b.x0, b.x1) for b in bands(cells)] == [(72.0, 110.0), (160.0, 200.0)]
    grid = matrix(cells)
    assert grid[2][1][0] is None and grid[2][1][2] and grid[0][1][0].text == "x"
    assert sureness(grid) == round(0.25 + 0.22 * 5 / 6 + 0.23 + 0.3 * (1 - 0.8 / 6 - 0.5 / 6), 3)


def test_tables_near_and_left_over(spark):
    from quire.operators import regions

    rows = [*_grid(_ROWS, [72.0, 160.0, 250.0, 360.0]), (1, 1, 90, "unknown", "Source: us", 80.0, 190.0, 140.0, 204.0), (1, 1, 91, "unknown", "far away", 80.0, 500.0, 140.0, 514.0)]
    blocks = spark.createDataFrame(rows, _BLOCK)
    cells = regions.table_cells(blocks)
    assert sorted(r.pos for r in regions.without_cells(blocks, cells).collect()) == [90, 91]
    assert [(r.pos, r.table_no) for r in regions.near_tables(blocks, cells).collect()] == [(90, 1)]


def test_table_overlay_of_a_weak_grid_is_lines(spark):
    from quire.operators.render import table_overlay, table_rows

    cells = spark.createDataFrame(
        [(1, 1, 1, 0, 0, "a", "A", 72.0, 100.0, 150.0, 130.0, False), (1, 1, 1, 0, 1, "b", "", 150.0, 100.0, 220.0, 130.0, False), (1, 1, 1, 1, 0, "", "", 72.0, 130.0, 150.0, 160.0, True)],
        "doc_id long, page_number int, table_no int, row_index int, column_index int, source_text string, translated_text string, x0 double, y0 double, x1 double, y1 double, empty_cell boolean",
    )
    weak = lambda flag: spark.createDataFrame([(1, 1, 1, flag)], "doc_id long, page_number int, table_no int, is_weak boolean")
    sure = table_overlay(cells, weak(False)).orderBy("column_index").collect()
    assert [(r.text, r.warning) for r in sure] == [("A", None), ("[review]", "masked_without_translation")] and all(r.font_size <= 9 for r in sure)
    plain = table_overlay(cells, weak(True)).collect()
    assert [(r.text, r.warning) for r in plain] == [("A | b", "weak_table_grid_detection")]
    assert [r.texts for r in table_rows(cells).orderBy("row_index").collect()] == [["A", "b"], [""]]


# Noise, duplicates, gates.


def test_noise_is_marked(spark):
    long = "The governance framework defines several principles for artificial intelligence systems and the agencies that run them."
    rows = [(1, 1, 0, "paragraph", long, 72.0, 100.0, 500.0, 130.0, 11.0), (1, 1, 1, "unknown", "several principles for artificial", 80.0, 104.0, 200.0, 116.0, 11.0)]
    rows += [(1, 1, k, "unknown", t, 72.0, 200.0 + 20 * k, 150.0, 212.0 + 20 * k, 11.0) for k, t in enumerate(["AI-powered", "However Issues", "Technology Startups", "Learning", "David Grey", "AI.", "AI PDF"], 2)]
    rows.append((1, 1, 20, "title", "Overview", 72.0, 700.0, 150.0, 712.0, 16.0))
    got = {r.pos: r for r in layout.mark_noise(spark.createDataFrame(rows, _BLOCK + ", size double")).collect()}
    assert {p for p, r in got.items() if r.type == "noise"} == {1, 2, 3, 4, 5}
    assert got[1].type == "noise" and (got[1].status, got[1].role, got[1].warnings) == ("needs_review", "noise", ["noise_block"])
    assert [got[p].type for p in (0, 6, 7, 8, 20)] == ["paragraph", "unknown", "unknown", "unknown", "title"]


def test_duplicates_by_type_and_worth(spark):
    box = (72.0, 100.0, 300.0, 112.0)
    rows = [(1, 1, 0, "unknown", "Some words here", *box, 0), (1, 1, 1, "title", "Some words here", *box, 0), (1, 1, 2, "footnote", "Some words here", *box, 0)]
    df = spark.createDataFrame(rows, _BLOCK + ", copy int")
    assert sorted(r.pos for r in layout.deduplicated(df).collect()) == [1, 2]  # the title is worth more; a footnote is another kind


def test_gates_count_translated_blocks(spark):
    from quire.operators.render import gates

    rows = [(1, "paragraph", "texte", "needs_review", None), (1, "table", "x", "pending", None), (2, "paragraph", "texte", "translated", None), (3, "table", "x", "translated", None)]
    got = {r.doc_id: (r.n, r.done, r.gate) for r in gates(spark.createDataFrame(rows, "doc_id long, type string, translated_text string, status string, warning string")).collect()}
    assert got == {1: (1, 0, "TRANSLATION_NOT_READY"), 2: (1, 1, "READY"), 3: (0, 0, "READY")}


def first_suspicious(spark, folder):
    """The first twenty of all scored blocks, and the rows of the query."""
    from quire.plans import queries

    rows = [r for r in queries.scored(spark, folder).collect() if r.warnings]
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id, r.pos))
    return [(r.doc_id, r.pos, r.type, r.source_text[:90], ",".join(sorted(r.warnings))) for r in rows[:20]], [tuple(r) for r in queries.suspicious_top20(spark, folder).collect()]


def test_suspicious_blocks_of_whole_input(spark, tmp_path):
    clean = "The committee reviewed the annual plan and approved every part of it."
    odd = ["\n".join(["Plan of the year", *[clean] * k, "who"]) for k in (0, 2, 9, 13)]
    few = [(9, odd[3]), (7, ""), (5, None), (8, odd[1])]  # fewer certain blocks than twenty: all documents count
    many = [(k, odd[k % 4]) for k in range(80, 0, -1)]
    for name, rows in (("few", few), ("many", many), ("none", [])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        want, got = first_suspicious(spark, f"{tmp_path}/{name}")
        assert got == want and len(want) == {"few": len(want), "many": 20, "none": 0}[name] and (name == "none" or want)


def test_suspicious_blocks_work_texts_out_once(spark):
    from quire.plans import queries

    plan = queries.suspicious_top20(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if line.lstrip(" :+-").startswith("Filter")]
    assert not any("regexp" in line or "RLIKE" in line for line in filters)


def test_reach(spark):
    from quire.operators import report

    rows = [(k // 2, 1, k) for k in range(50)]
    blocks = spark.createDataFrame(rows, "doc_id long, page_number int, pos int")
    kept = lambda certain: blocks.where(report.reach(certain)).count()
    assert kept(blocks) == 20 and kept(blocks.where("pos % 2 = 1")) == 40 and kept(blocks.where("pos < 19")) == 50 and kept(blocks.limit(0)) == 50
    assert kept(blocks.selectExpr("nullif(doc_id, doc_id) AS doc_id", "page_number", "pos")) == 50
    assert spark.sql("SELECT bigint(null) AS doc_id").where(report.reach(blocks)).count() == 1


def test_images_payloads_service(spark):
    from quire import service
    from quire.operators import batches, translate

    pictures = spark.createDataFrame([(1, 2, 1, "JPEG", bytearray(b"x"), 1.0, 2.0, 3.0, 4.0), (1, 2, 2, None, bytearray(b""), 1.0, 2.0, 3.0, 4.0)], "doc_id long, page_number int, image_no int, ext string, content binary, x0 double, y0 double, x1 double, y1 double")
    r = layout.image_blocks(pictures).collect()
    assert len(r) == 1 and (r[0].file_name, r[0].status, r[0].style.alignment, r[0].style.size) == ("image_001.jpg", "skipped", "center", None)
    m = spark.createDataFrame([(1, "batch_001", "completed", None), (1, "batch_002", "failed", "de")], "doc_id long, batch_id string, status string, target_language string")
    p = batches.payloads(m).collect()
    assert len(p) == 1 and (p[0].source_language, p[0].target_language, p[0].domain, p[0].translated_blocks_count) == ("en", "fr", "general", 0)
    w = spark.createDataFrame([(1, "batch_002", ["b", "c"]), (1, "batch_001", ["a", "b"])], "doc_id long, batch_id string, warnings array<string>")
    assert batches.payload_warnings(w).first().warnings == "a,b,c"
    assert service.health(spark)["status"] == "ok" and service.now_utc().endswith("Z") and service.storage_root("s3a://x/") == "s3a://x"
    ids = spark.range(3).select(service.document_id().alias("i")).collect()
    assert len({x.i for x in ids}) == 3 and all(x.i.startswith("doc_") for x in ids)
    e = spark.range(1).select(service.error(F.lit("TOO_MANY_PAGES")).alias("a"), service.error(F.lit(None).cast("string")).alias("b")).first()
    assert e.a.message and e.b is None
    rows = [(1, 1, 0, "title", "Overview of things", 72.0, 100.0, 300.0, 116.0, 16.0), (1, 1, 1, "paragraph", "This agreement defines the responsibilities of each party.", 72.0, 130.0, 400.0, 144.0, 11.0), (1, 1, 2, "image", "", 0.0, 0.0, 9.0, 9.0, 0.0)]
    done, states = translate.translate_document(spark.createDataFrame(rows, _BLOCK + ", size double"), translate.mock_translate)
    got = {r.pos: r for r in done.collect()}
    assert got[1].status == "translated" and got[1].translated_text and got[2].status == "skipped" and states.count() == 1
