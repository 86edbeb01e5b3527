"""Every operator and stage on odd rows and on empty tables."""

import public_tokenizers
import pytest

import corpus_pipeline
from maskframe.llm import op1_language_id as op1
from maskframe.llm import op2_sharding as op2
from maskframe.llm import op3_warc as op3
from maskframe.llm import op4_decontamination as op4
from maskframe.llm import op5_secret_scans as op5
from maskframe.llm import op6_suffix_dedup as op6
from maskframe.llm import op7_packing as op7
from maskframe.llm import op8_toxicity as op8
from maskframe.llm import op9_host_rules as op9
from maskframe.llm import op10_simhash as op10
from maskframe.llm._common import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0)


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=key)


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x or 0))


def test_language_id(odd, empty, odd_rows):
    got = rows(op1.language_id(odd))
    assert len(got) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3, 9))
    assert by_id[4]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert rows(op1.language_id(empty)) == []
    short = odd.sparkSession.createDataFrame([(100, "a.", None)], "doc_id long, text string, lang string")
    known = odd.select("doc_id", "text", "lang").unionByName(short)
    assert next(r for r in rows(op1.language_id(known)) if r["doc_id"] == 100)["lang_pred"] == "en"


def test_language_stage_keeps_what_predict_knows(spark, odd):
    """A script without labelled documents and rare words stay; texts without letters go."""
    extra = spark.createDataFrame([(100, "Κείμενο χωρίς ετικέτα", None), (101, "zqxj wvkq", None), (102, "42 !?", None)], "doc_id long, text string, lang string")
    df = odd.select("doc_id", "text", "lang").unionByName(extra)
    assert ids(op1.keep_known(df)) == ids(op1.language_id(df).where("lang_pred != 'und'"))
    assert {100, 101} <= set(ids(op1.keep_known(df))) and 102 not in ids(op1.keep_known(df))
    assert ids(op1.keep_known(extra)) == [100, 101]


def test_language_id_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in op1.language_id(df).collect()] == [("und", 0.0)]


def test_sharding(odd, empty, odd_rows):
    got = rows(op2.shards(odd, 8))
    assert len(got) == len(odd_rows)
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert next(r for r in got if r["doc_id"] == 1)["size"] == 1
    assert len({r["shard"] for r in got if r["doc_id"] in (6, 7)}) == 1
    assert rows(op2.shards(empty, 8)) == []


def test_warc(spark):
    page = "<html>" + "x" * 200
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nb" * 3
    data = [(1, "u", None), (2, None, ""), (3, "u\r\nX: y", page), (4, "u", page), (4, "u", page), (None, "u", page), (5, "u", tricky), (6, "u", "ends\r\n"), (7, "u", "ends\r\n\r\n"), (8, "u", "WARC/1.1\r\nContent-Length: 9999999\r\n\r\n" + "é" * 300), (9, "u", "\r\n\r\n\r\n"), (10, "u", "\r\r\n"), (None, None, "short")]
    path = scratch_path(spark, "warc-test")
    op3.write_warc(spark.createDataFrame(data, "page_id long, url string, html string"), path)
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in op3.read_warc(spark, path).collect()), key=repr)
    want = []
    for i, _, html in data:
        html, revisit = html or "", html == page and i != 3
        want.append((i, len(html.encode()), "revisit" if revisit else "response", 3 if revisit else None, None if revisit else html))
    assert got == sorted(want, key=repr)


def test_warc_empty(spark):
    path = scratch_path(spark, "warc-test")
    op3.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert op3.read_warc(spark, path, False).collect() == []


def test_decontamination(odd, empty, items, odd_rows):
    got = rows(op4.decontaminate(odd, items))
    assert len(got) == len(odd_rows)
    clean = next(r for r in got if r["doc_id"] == 1)
    assert (clean["n_words"], clean["n_hit"], clean["items"], clean["contaminated"]) == (0, 0, [], False)
    hit = [r for r in got if r["doc_id"] in (6, 7)]
    assert all(r["items"] == ["1", "4"] and r["contaminated"] for r in hit)
    assert rows(op4.decontaminate(empty, items)) == []
    assert all(r["n_hit"] == 0 for r in rows(op4.decontaminate(odd, items.limit(0))))


def test_secret_scans(odd, empty, odd_rows):
    got = rows(op5.secret_scan(odd))
    assert len(got) == len(odd_rows)
    spans = next(r for r in got if r["doc_id"] == 8)["spans"]
    text = next(t for i, t, *_ in odd_rows if i == 8)
    assert [(s["kind"], text[s["start"] : s["end"]]) for s in spans] == [("assign", "token: abcdefgh12345"), ("hex", "0123456789abcdef" * 2)]
    assert rows(op5.secret_scan(empty)) == []
    red = {r["doc_id"]: r for r in op5.redact(odd).collect()}
    assert red[8]["text"] == "été à la plage, où ça? ÉTÉ! [SECRET] [SECRET]" and red[8]["n_chars"] == len(red[8]["text"])
    assert red[1]["text"] is None and red[2]["text"] == ""


def test_suffix_dedup(odd, empty, odd_rows):
    got = rows(op6.remove_repeats(odd))
    assert len(got) == len(odd_rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_bytes"] == 0 and by_id[1]["n_spans"] == 0
    assert by_id[6]["n_removed"] == by_id[6]["n_bytes"] == by_id[7]["n_removed"]
    assert by_id[4]["n_removed"] == by_id[4]["n_bytes"] and by_id[5]["n_removed"] == by_id[4]["n_bytes"]
    assert by_id[11]["n_removed"] == 5000 and by_id[11]["n_spans"] == 1
    assert rows(op6.remove_repeats(empty)) == []


def test_packing(odd, empty, odd_rows):
    got = op7.best_fit_packing(odd, TOKENIZER).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in odd_rows}
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 1
    assert op7.best_fit_packing(empty, TOKENIZER).collect() == []


def test_toxicity(spark, odd, empty, odd_rows):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 0), (6, 1), (6, 0), (7, None), (None, 1)], "doc_id long, toxic int")
    got = rows(op8.toxicity(odd, labels))
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert rows(op8.toxicity(empty, labels)) == []
    assert all(r["score"] < 0.5 for r in rows(op8.toxicity(odd, labels.limit(0))))


def test_host_rules(odd, empty, odd_rows):
    got = rows(op9.host_rules(odd))
    assert len(got) == len(odd_rows)
    assert next(r for r in got if r["doc_id"] == 1)["base_failed"]
    assert {r["host"] for r in got if r["doc_id"] == 6} == {"host.example"}
    assert rows(op9.host_rules(empty)) == []


def test_simhash(odd, empty, odd_rows):
    got = rows(op10.simhash_classes(odd))
    assert len(got) == len(odd_rows)
    assert {r["component_id"] for r in got if r["doc_id"] in (6, 7)} == {6}
    assert {(r["fp"], r["component_id"]) for r in got if r["doc_id"] in (1, 2, 3)} == {(0, 1)}
    assert rows(op10.simhash_classes(empty)) == []
    kept = ids(op10.drop_near_duplicates(odd))
    assert kept.count(6) == 1 and 7 not in kept and 1 in kept and 2 not in kept


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, odd, empty, items, tmp_path, name, stage):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, odd, str(tmp_path))
    out.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == odd.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    assert stage(spark, empty, str(tmp_path)).collect() == []
