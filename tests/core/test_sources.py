import pytest

from pageloom.operators.frequency import accumulate
from pageloom.sources import corpus, files
from pageloom.streaming import counts


def write(path, text):
    path.write_text(text)
    return str(path)


def test_codepoint_list(spark, tmp_path):
    p = write(tmp_path / "a.txt", "# head\n0x0042,200 # with comment\n\n  0x0041,100\n0x45,\n0x41\n")
    got = [(r.codepoint, r.frequency) for r in files.codepoint_list(spark, p).orderBy("ord").collect()]
    assert got == [(0x42, 200), (0x41, 100), (0x45, None), (0x41, None)]
    first = files.by_frequency(files.codepoint_list(spark, p)).first()
    assert first.codepoint == 0x42


@pytest.mark.parametrize("line", ["abc", "0xfoo", "0x0043,30a0"])
def test_bad_lists(spark, tmp_path, line):
    with pytest.raises(Exception, match="not a codepoint line"):
        files.codepoint_list(spark, write(tmp_path / "b.txt", "0x41\n" + line + "\n")).collect()


def test_shards_and_records(spark, tmp_path):
    for i in range(2):
        write(tmp_path / f"f-0000{i}-of-00002", '{"codepoints": [66, 65], "count": 10}\n{"codepoints": [67], "count": 4}\n')
    write(tmp_path / "f-other", "x")
    found = files.shards(spark, f"{tmp_path}/f@*")
    assert len(found) == 2
    got = {(r.cp1, r.cp2): r.n for r in accumulate(files.frequency_records(spark, *found)).collect()}
    assert got == {(65, 66): 20, (67, 67): 8}
    with pytest.raises(FileNotFoundError):
        files.shards(spark, f"{tmp_path}/none@*")
    with pytest.raises(Exception, match="one or two"):
        files.frequency_records(spark, write(tmp_path / "bad", '{"codepoints": [1, 2, 3], "count": 1}\n')).collect()


def test_paths():
    assert files.join_path("/a/b", "c/d") == "/a/b/c/d"
    for bad in ("../x", "/etc", "c/../../x"):
        with pytest.raises(PermissionError):
            files.join_path("/a/b", bad)


def test_config():
    assert files.cost_config('{"overhead": 200}', '{"use_bigrams": false}')["overhead"] == 200
    with pytest.raises(ValueError):
        files.cost_config('{"nope": 1}')


def test_plan_round_trip(spark, sf_dir, tmp_path):
    font = corpus.font(corpus.pages(spark, sf_dir))
    seg = corpus.segments(font)
    cond = corpus.conditions(seg)
    files.write_plan(seg, corpus.patch_glyphs(seg, cond), cond, str(tmp_path / "plan"))
    again = files.read_plan(spark, str(tmp_path / "plan"))
    assert sorted(again[0].collect()) == sorted(seg.collect()) and again[2].count() == cond.count()


def test_streams(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    q = counts.page_counts(stream).writeStream.outputMode("complete").format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.dataset, r.cp): r.n for r in counts.page_counts(docs).collect()}
    assert {(r.dataset, r.cp): r.n for r in spark.table("kept").collect()} == want
