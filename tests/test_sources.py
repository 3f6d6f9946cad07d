"""Office files, corpora, evaluation sets, seams."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from quillspark.operators import seams
from quillspark.sources import corpora, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def docx():
    p = lambda s, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{s}</w:t></w:r></w:p>'
    cell = lambda s: f"<w:tc>{p(s)}</w:tc>"
    return zipped(word__document=f"<w:document {W}><w:body>{p('Top', 'Heading1')}{p('One two.')}<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl>{p('')}</w:body></w:document>")


def pptx():
    shape = lambda s, kind="": f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type={chr(34)}{kind}{chr(34)}/>" if kind else ""}</p:nvPr></p:nvSpPr><a:p><a:r><a:t>{s}</a:t></a:r></a:p></p:sp>'
    return zipped(ppt__presentation="<x/>", ppt__slides__slide10=f"<p:sld {A}>{shape('Last')}</p:sld>", ppt__slides__slide2=f"<p:sld {A}>{shape('Title', 'title')}{shape('Text')}</p:sld>", ppt__notesSlides__notesSlide2=f"<p:n {A}><a:t>said</a:t></p:n>")


def test_folder(spark, tmp_path):
    files = {"a.docx": docx(), "b.pptx": pptx(), "c.docx": b"PK\x03\x04broken", "d.txt": "中文 text\n\nmore".encode("gbk"), "e.txt": b" \n", "f.pdf": b"%PDF-1.4", "g.docx": docx(), "h.docx": zipped(word__document="<not closed")}
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    rows = {r.path.rpartition("/")[2]: r for r in office.read_folder(spark, str(tmp_path)).collect()}
    assert len(rows) == 8
    assert [(b.kind, b.level, b.text) for b in rows["a.docx"].blocks] == [("heading", 1, "Top"), ("paragraph", 0, "One two."), ("table", 0, "a | b")]
    assert [(b.kind, b.text, b.page) for b in rows["b.pptx"].blocks] == [("heading", "Title", 2), ("paragraph", "Text", 2), ("note", "said", 2), ("paragraph", "Last", 10)]
    assert {k: r.status for k, r in rows.items()} == {"a.docx": "ok", "b.pptx": "ok", "c.docx": "skipped", "d.txt": "ok", "e.txt": "skipped", "f.pdf": "skipped", "g.docx": "skipped", "h.docx": "failed"}
    assert rows["g.docx"].reason.startswith("copy of") and "ParseError" in rows["h.docx"].reason
    parsed = office.parse_files(spark.createDataFrame([("a.docx", docx()), ("b.pptx", pptx())], "path string, content binary"))
    assert {r.path: r.markdown for r in office.to_markdown(parsed).collect()}["a.docx"] == "# Top\n\nOne two.\n\n| a | b |"
    assert {(r.path, r.page) for r in office.pages(parsed, 10, 5).collect()} == {("a.docx", 1), ("a.docx", 2), ("b.pptx", 2), ("b.pptx", 10)}
    assert {r.format: r.ok for r in office.counts(parsed).collect()} == {"docx": 1, "pptx": 1}


def test_corpus(spark, tmp_path):
    new = {"title": "A", "abstract": "x", "full_text": [{"section_name": "Intro", "paragraphs": ["one", " ", "two"]}, {"section_name": None, "paragraphs": ["three"]}, {"section_name": "Empty", "paragraphs": []}], "qas": [{"question": "Why?", "question_id": "q1", "answers": [{"answer": {"evidence": ["the first evidence of the paper BIBREF1 and so on"], "highlighted_evidence": [], "extractive_spans": ["BIBREF19"]}}]}, {"question": "None?", "question_id": "q2", "answers": []}]}
    old = {"title": "B", "full_text": {"section_names": ["S"], "sections": ["body"]}, "qas": []}
    (tmp_path / "c.json").write_text(json.dumps({"p1": new, "p2": old}))
    papers = corpora.papers(corpora.corpus(spark, str(tmp_path / "c.json")))
    assert {(r.id, r.page, r.name, r.body) for r in corpora.sections(papers).collect()} == {("p1", 1, "Intro", "one\ntwo"), ("p1", 2, "Section", "three"), ("p2", 1, "S", "body")}
    assert [(r.question_id, len(r.spans)) for r in corpora.evidence(papers).collect()] == [("q1", 1)]
    assert corpora.tasks(papers).first().probes == ["the first evidence of the paper"]


def test_evaluation_set(spark, tmp_path):
    rows = [{"id": "r1", "type": "retrieval", "query": "q", "gold_keys": ["k"]}, {"id": "r2", "type": "retrieval", "query": "q", "gold_keys": []}, {"id": "i1", "type": "intent", "query": "q", "gold_intent": "qa"}, {"id": "x", "type": "odd", "gold_keys": ["k"]}]
    (tmp_path / "e.json").write_text(json.dumps(rows))
    good, bad = corpora.evaluation_set(spark, str(tmp_path / "e.json"))
    assert {r.id for r in good.collect()} == {"r1", "i1"} and {r.id for r in bad.collect()} == {"r2", "x"}


def test_embedding_seam(spark):
    def model(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, "bad one"), (3, "a\x01b"), (4, None), (5, " ")], "id int, t string")
    rows = {r.id: r for r in seams.embedded(df, model, "id", "t").collect()}
    assert set(rows) == {1, 2, 3} and rows[3].embedding == [2.0, 1.0] and rows[2].embedding is None and "refused" in rows[2].error


def test_strategies_and_reranking(spark):
    docs = spark.createDataFrame([(1, "channel estimation for massive MIMO", "x"), (2, "survey of beamforming", "y"), (3, "machine translation", None)], "id int, title string, body string")
    s = seams.retrievers()
    assert s.rank(docs, "channel estimation massive MIMO", 1)[0].first().id == 1
    assert s.rank(docs, "beamforming", 1, "bm25")[0].first().id == 2
    s.add("broken", lambda *a: 1 / 0)
    ranked, used, note = s.rank(docs, "beamforming", 1, "broken")
    assert used == "phrases" and "ZeroDivisionError" in note and ranked.first().id == 2
    pool = spark.createDataFrame([(3, 1), (2, 2), (1, 3)], "id int, rank int")
    assert [r.id for r in seams.reranked(docs, pool, "beamforming", 3).orderBy("rank").collect()] == [2, 3, 1]


def test_vector_store(spark, tmp_path):
    store = seams.ParquetVectors(spark, str(tmp_path / "v"))
    assert store.search([1.0, 0.0], 2).count() == 0
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.8, 0.6]), (3, "b", [0.0, 1.0])], "id bigint, kind string, embedding array<double>")
    store.upsert(rows)
    assert [(r.id, round(r.score, 6)) for r in store.search([1.0, 0.0], 3).collect()] == [(1, 1.0), (2, 0.8), (3, 0.0)]
    assert [r.id for r in store.search([1.0, 0.0], 3, F.col("kind") == "b").collect()] == [3]
    store.upsert(spark.createDataFrame([(1, "a", [0.0, 1.0])], "id bigint, kind string, embedding array<double>"))
    store.delete(spark.createDataFrame([(2,), (9,)], "id bigint"))
    assert {r.id: round(r.score, 6) for r in store.search([0.0, 1.0], 3).collect()} == {1: 1.0, 3: 1.0}
    store.rebuild(rows.where("id = 2"))
    assert [r.id for r in store.rows().collect()] == [2]


def test_sql_functions(spark):
    assert "quill_cosine" in seams.register_functions(spark)
    r = spark.sql("SELECT quill_bare_doi('https://doi.org/10.1/x') a, quill_norm('  A  b ') b, quill_cosine(array(1D, 0D), array(0.8D, 0.6D)) c, quill_cosine(array(1D), array(1D, 2D)) d").first()
    assert r.a == "10.1/x" and r.b == "a b" and abs(r.c - 0.8) < 1e-6 and r.d is None
