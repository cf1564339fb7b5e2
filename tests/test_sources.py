import pytest

from touchline.sources.files import create_database, image_frames, save_by_match


def test_image_frames(spark, tmp_path):
    for name in ("3/frame_7.png", "3/8.png", "3/notes.txt.bak", "x/readme.md"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"abc")
    got = image_frames(spark, str(tmp_path), fps=0).orderBy("frame_num").collect()
    assert [(r.match_id, r.frame_num, bytes(r.image), r.seconds) for r in got] == [(3, 7, b"abc", 0.28), (3, 8, b"abc", 0.32)]


def test_saving_a_match_again_replaces_only_it(spark, tmp_path):
    path = str(tmp_path / "t")
    save_by_match(spark.createDataFrame([(1, "a"), (2, "b")], "match_id long, v string"), path)
    save_by_match(spark.createDataFrame([(2, "c")], "match_id long, v string"), path)
    assert sorted((r.match_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_database_names(spark):
    with pytest.raises(ValueError):
        create_database(spark, "x; drop")
