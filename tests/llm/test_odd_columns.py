"""Columns of the user's that clash with the operators' own, and records inside records."""

import zlib

from pyspark.sql import functions as F

from nubila.llm import pii, warc


def odd_documents(spark):
    rows = [(1, "write to ann@example.org today", "u", "s"), (2, "plain words only here", "v", "t"), (2, "plain words only here", "v", "t"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    own = {"base": "b", "spans": "s", "sanitised": "z", "digest": "d", "label": "l", "row": "r", "a.b": "dot", "te`ck": "tick", "__row": "w", "score": "c"}
    return docs.withColumns({"n_chars": F.char_length("text").cast("long")} | {k: F.concat(F.lit(v), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for k, v in own.items()})


def quoted(docs):
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def test_pipeline_keeps_the_values_of_all_columns(spark, small):
    import corpus_pipeline

    docs = odd_documents(spark)
    want = sorted((tuple(r) for r in docs.select(*quoted(docs)).distinct().collect()), key=repr)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        got = [tuple(r) for r in out.select(*quoted(docs)).distinct().collect()]
        if name == "pii":
            at = docs.columns.index("text"), docs.columns.index("n_chars")
            clean = lambda rows: sorted((tuple(v for i, v in enumerate(r) if i not in at) for r in rows), key=repr)
            assert clean(got) == clean(want) and out.count() == docs.count()
            texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.select("doc_id", "text", "n_chars").collect()}
            assert texts == {1: ("write to [EMAIL] today", 22), 2: ("plain words only here", 21), None: ("", 0)}
        else:
            assert sorted(got, key=repr) == want, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() == 4


def test_names_with_dots_in_the_personal_data_operator(spark):
    out = pii.sanitise_documents(odd_documents(spark))
    assert {r[0] for r in out.select("`a.b`").collect()} == {"dot1", "dot2", "dot-"}


def member(content, level):
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def said(kind, block, length=None, name="Content-Length"):
    return b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:x:" + kind + b">\r\n" + name.encode() + b": " + (length or str(len(block)).encode()) + b"\r\n\r\n" + block + b"\r\n\r\n"


def read(spark, tmp_path, members, split):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    files = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), sum(map(len, members)))], "path string, bytes long")
    return sorted((r["offset"], r["record_type"], r["payload_bytes"]) for r in warc.read_warc(files, split_bytes=split).collect())


def test_records_inside_a_stored_block_are_not_owned(spark, tmp_path):
    inner = b"".join(member(said(b"inner", b"x" * n), 6) for n in (5, 900, 3))
    members = [member(said(b"first", b"a" * 50), 6), member(said(b"outer", b"HTTP/1.1 200 OK\r\n\r\n" + inner * 4), 0), member(said(b"last", b"b"), 6), b"junk between", member(said(b"end", inner), 0)]
    starts = [sum(map(len, members[:i])) for i in (0, 1, 2, 4)]
    whole = read(spark, tmp_path, members, 1 << 20)
    assert [(o, k) for o, k, _ in whole] == list(zip(starts, ("first", "outer", "last", "end"), strict=True))
    for split in (20, 64, 333):
        assert read(spark, tmp_path, members, split) == whole


def test_lengths_that_cannot_be_read(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\ncontent-LENGTH: 3\r\n\r\nabc"
    members = [member(said(b"one", b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\nabcd", b"a lot"), 6), member(said(b"two", http, name="content-length"), 6), member(said(b"three", b"", b"-5"), 6), member(b"not a record", 6)]
    assert [(k, n) for _, k, n in read(spark, tmp_path, members, 4096)] == [("one", 8), ("two", 3), ("three", 0)]
