import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanloom import cli
from spanloom.functions import text
from spanloom.operators import dataset, tokens
from spanloom.sources import files
from spanloom.streaming.align import align_stream, for_each_batch


def test_sniffing_and_whole_texts(spark, tmp_path):
    cases = {"plain": b"abc", "nul": b"a\0b", "latin": b"\xe9\xe8", "cut": b"a" * 1023 + "é".encode() + b"b", "wide": b"a" * 1022 + "😀".encode(), "late": b"a" * 2000 + b"\0"}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: r.is_text for r in files.sniff(spark, str(tmp_path)).collect()}
    assert got == {"plain": True, "nul": False, "latin": False, "cut": True, "wide": True, "late": True}
    assert files.read_texts(spark, str(tmp_path / "cut")).first().text == cases["cut"].decode()
    with pytest.raises(Exception, match="appears to be binary"):
        files.read_texts(spark, str(tmp_path / "nul")).collect()
    assert files.load_text(str(tmp_path / "plain")) == "abc" and files.load_text("no such file") == "no such file"
    with pytest.raises(ValueError):
        files.load_text(str(tmp_path / "latin"))


SQUAD = {"data": [{"title": "T", "paragraphs": [{"context": "the cat sat on the mat", "qas": [{"id": "1", "question": "who?", "answers": [{"text": "cat sat on", "answer_start": 4}, {"text": "the", "answer_start": 15}]}, {"id": "2", "is_impossible": True, "answers": [{"text": "the", "answer_start": 0}]}]}]}, {"paragraphs": [{"context": "x", "qas": [{"answers": []}]}]}]}


def test_question_answering_file_to_frames(spark, tmp_path):
    (tmp_path / "train-v2.0.json").write_text(json.dumps(SQUAD))
    records = files.read_squad(spark, str(tmp_path), "train")
    assert [(r.title, r.target, r.idx_start, r.question, r.question_id) for r in records.collect()] == [("T", "cat sat on", 4, "who?", "1"), ("T", "the", 15, "who?", "1")]
    with pytest.raises(ValueError):
        files.read_squad(spark, str(tmp_path), "test")
    clean = dataset.keep_naive(records)
    assert [r.target for r in clean.collect()] == ["cat sat on"]
    shifted = dataset.shift(clean)
    assert (shifted.first().target, shifted.first().idx_start) == (" cat sat on", 3) and shifted.agg(dataset.shift_rule().alias("ok")).first().ok
    assert dataset.span_mismatches(shifted).count() == 0
    frames = dataset.by_split({"train": dataset.group_starts(shifted), "dev": dataset.group_starts(clean)})
    files.write_frames(frames, str(tmp_path / "out"))
    back = files.read_frame(spark, str(tmp_path / "out/split=train"))
    assert [tuple(r) for r in back.collect()] == [("the cat sat on the mat", " cat sat on", [3])]


def test_row_ids_are_dense(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "a int, b int").repartition(6)
    got = dataset.add_row_id(df, ["a", "b"]).collect()
    assert [r.row_id for r in sorted(got, key=lambda r: (r.a, r.b))] == list(range(500))


def test_subwords_and_their_ablation(spark):
    bpe = tokens.subword_tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    df = spark.createDataFrame([(1, "Single-cell rnaseq identified Sox2-positive cells. <|endoftext|>"), (2, ""), (3, None)], "id long, text string")
    rows = tokens.tokenize(df, "id", "text", "token", bpe).orderBy("pos").collect()
    source = df.first().text
    listed = df.select("id", F.explode(bpe(text.norm_text("text"))).alias("t")).select("t.*").collect()
    assert [(r.token, r.enc_token, r.start_idx, r.end_idx) for r in rows] == [tuple(r) for r in listed]
    assert "".join(r.token for r in rows) == source and all(source[r.start_idx : r.end_idx] == r.token for r in rows)
    pairs = spark.createDataFrame([("a b c d e f", "00000000000a"), ("a", "00000000000b")], "t string, k string")
    got = pairs.select(dataset.ablate_subword(bpe)("t", "k").alias("a")).select("a.*").collect()
    at = random.Random(3 ^ 10).randint(1, 4)
    assert got[0].idx == at and got[0].target == "".join(x for i, x in enumerate(["a", " b", " c", " d", " e", " f"]) if i != at)
    assert got[1].target is None
    assert pairs.select(dataset.ablate_word(F.col("t"), F.col("k"))[0].alias("x")).collect()[1].x is None
    assert pairs.select(text.short_hash("t").alias("h")).first().h == __import__("hashlib").sha256(b"a b c d e f").hexdigest()[:7]


def test_commands(spark, tmp_path, capsys):
    source, target = "A B A B A B A B", "A B A"
    assert cli.main(["aln", "-s", source, "-tt", "whitespace", target]) == 0
    found = json.loads(capsys.readouterr().out)
    assert len(found) == 10 and [t["start_idx"] for t in found[0]] == [0, 2, 4] and found[0][0]["enc_token"] == "A"
    out = tmp_path / "o.json"
    (tmp_path / "s.txt").write_text(source)
    assert cli.main(["--verbose", "aln", "-s", str(tmp_path / "s.txt"), "--single", "-o", str(out), " A B"]) == 0
    assert [t["token"] for t in json.loads(out.read_text())] == [" A", " B"]
    assert cli.main(["aln", "-s", "x", "--single", "-tt", "whitespace", "y"]) == 0
    assert capsys.readouterr().out.strip() == "null"
    assert cli.main(["light", "-s", source, "-tt", "whitespace", "-o", str(out), "--compat", "A B A B A B A B"]) == 0
    assert out.read_text().count("\033[42m") == 8
    assert cli.main([]) == 1 and cli.main(["aln"]) == 1
    assert cli.main(["light", "-s", "x", "-tt", "whitespace", "y"]) == 0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("A B A B", "A B"), ("x", "y")], "source string, target string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = align_stream(stream).writeStream.format("memory").queryName("aligned").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(map(str, r)) for r in spark.sql("select source, n, first, starts from aligned").collect()}
    assert got == {tuple(map(str, r)) for r in align_stream(rows).select("source", "n", "first", "starts").collect()}
    q = for_each_batch(stream, lambda b: b.groupBy("target").count(), str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
