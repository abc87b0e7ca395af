import pytest

from quern.operators.filters import NumericRange, Term
from quern.operators.scorers import BM25
from quern.plans.planner import Search
from quern.sources.index import text_field
from quern.sources.loaders import base36, convert, dump, read_json, read_lines
from quern.sources.policies import Segment, Tier, by_accumulated_bytes, by_bytes, by_count, by_fill, by_live
from quern.sources.snapshot import IndexNotFound, Reader, Writer
from quern.streaming.append import append_stream


def docs(spark, *texts):
    return spark.createDataFrame([(t, k) for k, t in enumerate(texts)], "text string, n int")


def live(spark, root, fields):
    return sorted(r.text for r in Reader.open(spark, root, tuple(fields)).index.live_docs().collect())


def test_life_cycle(spark, tmp_path):
    root, fields = f"file://{tmp_path}/i", [text_field("text")]
    with pytest.raises(IndexNotFound):
        Reader.open(spark, root)
    w = Writer(spark, root, fields)
    with pytest.raises(RuntimeError):
        Writer(spark, root, fields)
    w.insert(docs(spark, "a b", "b c", "c d")).remove(Term("text", "a")).insert(docs(spark, "a z"))
    assert w.commit("first") and not w.commit()
    first = Reader.open(spark, root, tuple(fields))
    assert live(spark, root, fields) == ["a z", "b c", "c d"] and first.manifest.payload == "first"
    assert first.docs_count() == 4 and first.live_docs_count() == 3 and first.reopen() is first
    # a replacement without a match is dropped, one with a match takes effect
    w.replace(Term("text", "nothing"), docs(spark, "x")).replace(Term("text", "z"), docs(spark, "y"))
    w.begin()
    assert live(spark, root, fields) == ["a z", "b c", "c d"]
    w.commit()
    assert live(spark, root, fields) == ["b c", "c d", "y"]
    assert first.live_docs_count() == 3 and first.reopen().manifest.version == 2
    w.insert(docs(spark, "lost"))
    w.begin()
    w.rollback()
    assert live(spark, root, fields) == ["b c", "c d", "y"]
    assert w.consolidate(by_count(10)) and live(spark, root, fields) == ["b c", "c d", "y"]
    merged = Reader.open(spark, root, tuple(fields))
    assert merged.docs_count() == merged.live_docs_count() == 3 and len(merged.manifest.segments) == 1
    assert sorted(r.doc_id for r in Search(merged.index).matches(Term("text", "c")).collect()) == [2, 3]
    assert w.clean()
    other = Writer(spark, f"{root}2", fields)
    other.import_index(merged).insert(docs(spark, "new"))
    other.commit()
    assert live(spark, f"{root}2", fields) == ["b c", "c d", "new", "y"]
    other.clear()
    other.commit()
    assert Reader.open(spark, f"{root}2").live_docs_count() == 0
    w.close()
    Writer(spark, root, fields).close()


def test_primary_sort_and_ids(spark, tmp_path):
    root = f"file://{tmp_path}/i"
    w = Writer(spark, root, [text_field("text")], sort_by=["n"])
    w.insert(docs(spark, *"edcba").repartition(3))
    w.commit()
    rows = sorted((r.doc_id, r.n) for r in Reader.open(spark, root).index.docs.collect())
    assert rows == [(k + 1, k) for k in range(5)]


def test_policies():
    s = [Segment("a", 10, 10, 100), Segment("b", 10, 5, 10), Segment("c", 10, 0, 40), Segment("d", 4, 4, 10)]
    assert by_bytes(1.0)(s) == ["b", "c", "d"] and by_accumulated_bytes(0.2)(s) == ["b", "d"] and by_count(2)(s) == ["a", "b"]
    assert by_fill(0.5)(s) == ["b", "c"] and by_live(1.0)(s) == ["c", "d"]
    assert by_bytes(1.0)([]) == by_live(1.0)([]) == Tier()([]) == []
    assert set(Tier()(s)) >= {"c"} and set(Tier(2, 10)(s)) == {"b", "c", "d"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    root, fields = f"file://{tmp_path}/i", [text_field("text")]
    for k in range(3):
        docs(spark, f"word{k}", "both").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    w = Writer(spark, root, fields)
    stream = spark.readStream.schema("text string, n int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    append_stream(stream, w, f"{tmp_path}/check").awaitTermination()
    reader = Reader.open(spark, root, tuple(fields))
    assert reader.live_docs_count() == 6 and reader.manifest.payload["batch"] == 2
    assert Search(reader.index).matches(Term("text", "both")).count() == 3
    assert Search(reader.index).matches(NumericRange("n", 1, None)).count() == 3


def test_loaders(spark, tmp_path):
    (tmp_path / "lines.tsv").write_text("T\t2020\tsome body\nU\t2021\tmore\n")
    rows = read_lines(spark, str(tmp_path / "lines.tsv")).collect()
    assert [(r.title, r.body, r.id, r.timesecnum) for r in rows] == [("T", "some body", "000000", 0), ("U", "more", "000001", 0)]
    (tmp_path / "x.json").write_text('[{"a": 1, "b": ["x"]}, {"a": 2}]')
    assert sorted(r.a for r in read_json(spark, str(tmp_path / "x.json")).collect()) == [1, 2]
    from pyspark.sql import functions as F

    assert spark.range(35, 37).select(base36(F.col("id"), 3)).first()[0] == "00z"
    from quern.sources.index import Index

    saved = Index.build(spark.createDataFrame([(1, "a b a")], "doc_id long, text string"), [text_field("text")]).save(f"{tmp_path}/s")
    dump(saved, f"{tmp_path}/d")
    assert spark.read.json(f"{tmp_path}/d").count() == 2
    convert(spark, f"{tmp_path}/s", f"{tmp_path}/z", "zstd")
    assert Index.open(spark, f"{tmp_path}/z").term_dict.count() == 2


def test_committed_scores_read_thin_tables(spark, tmp_path):
    """One term over a committed index: its postings' scan names the term, and nothing else of the postings is read."""
    w = Writer(spark, f"{tmp_path}/thin", [text_field("t")])
    for text in ("red sails", "blue sails and red"):
        w.insert(spark.createDataFrame([(text,)], "t string"))
    w.commit()
    w.close()
    index = Reader.open(spark, w.root, tuple(w.fields)).index
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    found = Search(index, BM25()).matches(Term("t", "red"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    # postings are told by tf, the dictionary by df, the counts by n_docs; norms and documents aren't read
    kinds = [next((k for k in ("n_docs:", "df:", "tf:") if k in x.split("ReadSchema")[1]), "other") for x in scans]
    assert set(kinds) == {"tf:", "df:", "n_docs:"} and all("= red)" in x or "EqualTo(term,red)" in x for x, k in zip(scans, kinds) if k != "n_docs:"), scans
