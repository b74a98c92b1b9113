"""From marked-up files to ranked results, and the ranking by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark import engine
from tidemark.operators import index as ix
from tidemark.operators import ranking as rk
from tidemark.sources import corpus, fields, sinks
from tidemark.streaming import incremental

DOCS = {
    "FX-0001": ("<DATE1> 5 May 94* </DATE1>\n<TI> Sample   title </TI>\n<F P=104> New York Harbor </F>\n<F P=105> English </F>", "Ships left on 13 May 1994 with cargo worth $450,000. Bob paid."),
    "FX-0002": ("<DATE1> MAR 7 95 </DATE1>\n<HEADLINE> <b> Café news </HEADLINE>\n<F P=104> Paris \n<F P=105> (French) </F>", "Bob saw ships. Prices CELLRULE rose 5 percent <b>again</b> in paris."),
    "FX-0003": ("<DATE> 940613 </DATE>\n<F P=105> The </F>", "ships ships ships; bob slept."),
    "FX-0004": ("<DATE> Monday, June 13, 1994 </DATE>", "Grain was sold."),
    "FX-0005": ("<DATE1> 000 000 96 </DATE1>", "Paris, Paris and York."),
    "FX-0006": ("<DATE1> nothing at all </DATE1>", ""),
    "FX-0007": ("<DATE1> 9 Jun 9? </DATE1>", "a state-of-the-art mill"),
}
DATES = {"FX-0001": "1994-05-05", "FX-0002": "1995-03-07", "FX-0003": "1994-06-13", "FX-0004": "1994-06-13", "FX-0005": "1996", "FX-0006": "", "FX-0007": "06-09"}


@pytest.fixture(scope="module")
def gazetteer(spark):
    rows = [("new york", "United States", "USD", "321M"), ("paris", "France", "EUR", "66M"), ("york", "Britain", "GBP", "65M")]
    return spark.createDataFrame(rows, "city string, country string, currency string, population string")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for i, part in enumerate((["FX-0001", "FX-0002"], ["FX-0003", "FX-0004", "FX-0005", "FX-0006", "FX-0007"])):
        (root / f"f{i}").mkdir()
        body = "".join(f"<DOC>\n<DOCNO> {d} </DOCNO>\n{DOCS[d][0]}\n<TEXT>\n{DOCS[d][1]}\n</TEXT>\n</DOC>\n" for d in part)
        (root / f"f{i}" / "file").write_bytes(body.encode("latin-1"))
    (root / "stop_words.txt").write_text("the\nof\na\nand\non\nwith \nin\n")
    return root


@pytest.fixture(scope="module")
def built(spark, folder, gazetteer, tmp_path_factory):
    return engine.build_corpus(spark, f"file://{folder}", gazetteer, f"file://{tmp_path_factory.mktemp('index')}")


def test_fields(spark, folder, gazetteer):
    docs = fields.with_city(fields.documents(corpus.read_corpus(spark, f"file://{folder}")), gazetteer)
    got = {r["doc_id"]: r for r in docs.collect()}
    assert {k: r["date"] for k, r in got.items()} == DATES
    one, two = got["FX-0001"], got["FX-0002"]
    assert (one["title"], one["city"], one["language"]) == ("Sample title", "New york", "English")
    assert (two["title"], two["city"], two["language"]) == ("Café news", "Paris", "French")
    assert two["text"] == "Bob saw ships. Prices rose 5 percent b again /b in paris."
    assert (got["FX-0003"]["language"], got["FX-0004"]["title"], got["FX-0006"]["text"]) == ("", "", "")


def test_index_tables(built):
    terms = {r["term"]: r for r in built.terms.collect()}
    assert (terms["ships"]["cf"], terms["ships"]["df"], terms["ships"]["display"]) == (5, 3, "ships")
    assert terms["bob"]["display"] == "bob" and terms["grain"]["display"] == "GRAIN"
    assert terms["1994-05-13"]["df"] == 1 and terms["450,000 Dollars"]["cf"] == 1 and terms["5%"]["cf"] == 1 and "the" not in terms
    assert {"state-of-the-art", "state", "art", "mill"} <= set(terms)
    docs = {r["doc_id"]: r for r in built.docs.collect()}
    assert (docs["FX-0003"]["max_tf"], docs["FX-0003"]["length"], docs["FX-0003"]["n_terms"]) == (3, 5, 3)
    assert (docs["FX-0006"]["max_tf"], docs["FX-0006"]["length"]) == (1, 0)
    said = {(r["city"], r["doc_id"]): r["positions"] for r in built.mentions.collect()}
    assert said == {("paris", "FX-0002"): [11], ("paris", "FX-0005"): [0, 1]}
    assert [r["language"] for r in built.languages().collect()] == ["English", "French"]
    assert [r["city"] for r in built.city_names().collect()] == ["New york", "Paris"]
    assert {r["term"] for r in built.key_entities("FX-0004").collect()} == {"grain"}
    s = built.summary().first()
    assert s["documents"] == 7 and s["terms"] == len(terms) and s["seconds"] > 0


def test_postings_add_up(built):
    tf = {r["doc_id"]: r["s"] for r in built.postings.groupBy("doc_id").agg(F.sum("tf").alias("s")).collect()}
    docs = built.docs.collect()
    assert all(tf.get(r["doc_id"], 0) == r["length"] and r["max_tf"] <= max(1, r["length"]) for r in docs)
    assert all(r["df"] <= len(docs) for r in built.terms.collect())


def test_search_filters_and_export(spark, built, tmp_path):
    hits = [r["doc_id"] for r in built.search("ships").orderBy("rank").collect()]
    assert sorted(hits) == ["FX-0001", "FX-0002", "FX-0003"]
    assert [r["doc_id"] for r in built.search("ships", languages=["French"]).collect()] == ["FX-0002"]
    assert {r["doc_id"] for r in built.search("bob paris", cities=["Paris"]).collect()} == {"FX-0002", "FX-0005"}
    assert built.search("ships", cities=["Nowhere"]).count() == 0 and built.search("unknownword").count() == 0
    money = built.search("worth $450,000")
    assert [r["doc_id"] for r in money.collect()] == ["FX-0001"]
    syn = spark.createDataFrame([("corn", 1, "grain", 20000), ("corn", 2, "ships", 5000)], "word string, rank int, sim_word string, score bigint")
    assert [r["doc_id"] for r in built.search("corn", synonyms=syn).collect()] == ["FX-0004"]
    sinks.write_run(built.search("ships"), f"file://{tmp_path}/run")
    assert (tmp_path / "run").is_file() and not list(tmp_path.glob("*.parts"))
    lines = sorted((tmp_path / "run").read_text().splitlines())
    assert lines == [f"0 0 {d} 1  2 mt" for d in sorted(hits)]


def test_topics_file(spark, built, tmp_path):
    (tmp_path / "topics.txt").write_text("<num> Number: 35 1 \n<title> grain \nsold\n\n<desc> Description: \nabout ships\n<narr> none\n<num> Number: 352\n<title> paris\n<desc> Description:\n\n<narr>\n")
    t = corpus.read_topics(spark, f"file://{tmp_path}/topics.txt")
    assert sorted((r["query_id"], r["title"], r["descr"]) for r in t.collect()) == [("351", "grain sold", "about ships"), ("352", "paris", "")]
    q = {(r["query_id"], r["term"]): r["weight"] for r in rk.query_terms(t).collect()}
    assert q == {("351", "grain"): 1, ("351", "sold"): 1, ("351", "about"): 0.5, ("351", "ships"): 0.5, ("352", "paris"): 1}
    assert built.search_topics(t).select("query_id").distinct().count() == 2


def test_load_stem_and_drop(spark, built, folder, gazetteer, tmp_path):
    path = f"file://{tmp_path}/ix"
    stemmed = engine.build_corpus(spark, f"file://{folder}", gazetteer, path, stem=True)
    assert {r["term"] for r in stemmed.terms.collect()} >= {"ship", "bob"}
    assert {r["doc_id"] for r in engine.load(spark, path, True).search("ship").collect()} == {"FX-0001", "FX-0002", "FX-0003"}
    engine.drop(spark, path, True)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        engine.load(spark, path, True)


def test_ranking_by_hand(spark):
    docs = spark.createDataFrame([("d", 2, 2), ("e", 2, 1), ("f", 2, 1), ("g", 2, 1)], "doc_id string, length long, max_tf int")
    posts = spark.createDataFrame([("x", "d", 2), ("y", "d", 1), ("y", "e", 1), ("y", "f", 1), ("y", "g", 1)], "term string, doc_id string, tf int")
    q = spark.createDataFrame([("1", "x", 1.0), ("2", "y", 1.0), ("3", "zzz", 1.0)], "query_id string, term string, weight double")
    got = {(r["query_id"], r["doc_id"]): r for r in rk.scores(q, posts, docs).collect()}
    assert abs(got["1", "d"]["bm25"] - 1.680790) < 1e-6 and got["1", "d"]["cosine"] == pytest.approx(1) and abs(got["1", "d"]["score"] - 1.476553) < 1e-6
    # every document has y: the inverse frequency is negative in one part and zero in the other
    assert got["2", "e"]["cosine"] == 0 and got["2", "e"]["bm25"] == pytest.approx(math.log2(0.5 / 4.5) * 2.2 / 2.2) and len(got) == 5
    assert [r["doc_id"] for r in rk.top(rk.scores(q, posts, docs), 2).where("query_id = '2'").orderBy("rank").collect()] == ["d", "e"]  # equal scores


def test_display_case(spark):
    def shown(*texts):
        d = spark.createDataFrame([(str(i), "", i, t) for i, t in enumerate(texts)], "doc_id string, path string, ord int, text string")
        return {r["term"]: r["display"] for r in ix.dictionary(ix.occurrences(d)).collect()}["bob"]

    assert [shown(*t) for t in (["Bob"], ["BOB"], ["Bob bob"], ["Bob BOB"], ["BOB Bob"], ["Bob", "BOB"], ["Bob", "x bob"])] == ["BOB", "bob", "bob", "BOB", "bob", "BOB", "bob"]


def test_stream_counts_once(spark, tmp_path):
    rows = [(f"d{i}", "", i, "ships and grain") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id string, path string, ord int, text string")
    for part in (df.where("ord < 3"), df.where("ord >= 3")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        incremental.index_stream(s, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r["term"], r["doc_id"]): (r["tf"], r["df"]) for r in incremental.merged(spark, f"{tmp_path}/out").collect()}
    assert len(got) == 18 and set(got.values()) == {(1, 6)}


def test_countries_and_places(spark, tmp_path):
    (tmp_path / "w.csv").write_text('"city","city_ascii","lat","lng","country","iso2"\n"Pâris","Paris","1","2","France","FR"\n"Paris","Paris","1","2","Texas","US"\n"Oslo","Oslo","1","2","Norway","NO"\n')
    (tmp_path / "c.json").write_text('[{"alpha2Code":"FR","name":"France","population":66710000,"currencies":[{"code":"EUR"}]},{"alpha2Code":"NO","name":"Norway","population":900,"currencies":[{"code":"NOK"}]}]')
    g = corpus.gazetteer(corpus.read_places(spark, f"file://{tmp_path}/w.csv"), corpus.read_countries(spark, f"file://{tmp_path}/c.json"))
    assert sorted(tuple(r) for r in g.collect()) == [("oslo", "Norway", "NOK", ""), ("paris", "France", "EUR", "66.71M")]


def test_point_reads(spark, folder, built):
    assert built.read_doc("FX-0003").select("doc_id", "max_tf").collect() == [("FX-0003", 3)] and built.read_doc("none").count() == 0
    raw = corpus.read_corpus(spark, f"file://{folder}")
    assert [r["doc_id"] for r in fields.documents(engine.read_chunk(raw, "FX-0004")).collect()] == ["FX-0004"]


def test_search_reads_its_own_terms_only(built):
    plan = built.search("ships")._jdf.queryExecution().executedPlan().toString()
    assert "In(key" in plan or "EqualTo(key,ships)" in plan


def test_later_deliveries_replace_earlier_ones(spark, gazetteer, tmp_path):
    schema = "doc_id string, path string, ord int, text string, title string, language string, city string, date string"
    rows = [("a", "", 0, "Ships ships", "t", "English", "Paris", ""), ("b", "", 0, "grain in paris", "t", "French", "", "")]
    again = [("a", "", 0, "copper", "new", "English", "Paris", ""), ("a", "", 0, "copper", "new", "English", "Paris", "")]
    stop = spark.createDataFrame([("in",)], "word string")
    for part in (rows, again):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        incremental.index_stream(s, f"{tmp_path}/out", f"{tmp_path}/state", frozenset({"in"})).awaitTermination()
    index = incremental.publish(spark, f"{tmp_path}/out", gazetteer, stop, f"{tmp_path}/index")
    assert {(r["term"], r["doc_id"], r["tf"]) for r in index.postings.collect()} == {("copper", "a", 1), ("grain", "b", 1), ("paris", "b", 1)}
    assert {(r["doc_id"], r["title"]) for r in index.docs.collect()} == {("a", "new"), ("b", "t")}
    assert [r["doc_id"] for r in index.search("copper").collect()] == ["a"] and index.search("ships").count() == 0
