from pyspark.sql import functions as F

from markloom import streaming
from markloom.operators import decoded, normalized, token_rows
from markloom.sources import binary_files, write_tokens


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(5):
        (src / f"{i}.html").write_bytes(f"<p id={i}>text\r\n{i}</p>".encode() + b"\xff<b>z</b>")
    batch = streaming.token_stream(binary_files(spark, str(src)))
    write_tokens(batch, str(tmp_path / "batch"))
    q = streaming.write_stream(streaming.token_stream(streaming.file_stream(spark, str(src), 2)), str(tmp_path / "out"), str(tmp_path / "check"))
    assert q.awaitTermination(120)
    key = lambda df: sorted((r["path"].rsplit("/", 1)[1], r["pos"], r["kind"], r["value"] or "") for r in df.collect())
    one, two = key(spark.read.parquet(str(tmp_path / "out"))), key(spark.read.parquet(str(tmp_path / "batch")))
    assert one == two and len(one) == 5 * 12


def test_stages(spark):
    df = spark.createDataFrame([(1, bytearray(b"a\r\x85\nb\xffc"))], "doc_id long, content binary")
    row = normalized(decoded(df)).first()
    # the lone 85 is malformed and goes in decoding; FF as well, and the first error shows at byte 3
    assert (row["text"], row["error_pos"], row["sanitized_count"]) == ("a\nbc", 3, 0)
    assert token_rows(normalized(decoded(df)), "doc_id", F.col("text")).count() == 0
    assert normalized(decoded(df), max_codepoints=2).first()["text"] == "a\n"
