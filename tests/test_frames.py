"""Frames chosen by name before any is read."""

import os

import pytest

from pramana.sources import frames


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Folders of 1 to 40 frames; the content of a frame is its name."""
    top = tmp_path_factory.mktemp("frames")
    for n in range(1, 41):
        d = top / f"v{n:02d}"
        d.mkdir()
        for k in range(n):
            (d / f"f{k:03d}.jpg").write_bytes(f"{n}/{k}".encode())
        (d / "notes.txt").write_text("no frame")
    return str(top)


@pytest.mark.parametrize("wanted", [1, 2, 5, 8, 16, 40])
def test_places_follow_the_index_rule(spark, root, wanted):
    got = {}
    for r in frames.evenly_spaced(frames.frame_files(spark, root), wanted).collect():
        got.setdefault(int(r.folder[1:]), []).append(r.place)
    for n in range(1, 41):
        places = list(range(n)) if n <= wanted else [round(i * (n - 1) / max(wanted - 1, 1)) for i in range(wanted)]
        assert sorted(got[n]) == places, n
    assert len(got) == 40


def test_listing_asks_for_no_content(spark, root):
    plan = frames.evenly_spaced(frames.frame_files(spark, root), 4)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan and "content" not in plan


def test_only_chosen_frames_are_read(spark, root, tmp_path):
    chosen = frames.evenly_spaced(frames.frame_files(spark, root).where("folder in ('v03', 'v40')"), 4)
    got = {(r.folder, r.place): bytes(r.content) for r in frames.read_frames(chosen).collect()}
    assert got == {(f"v{n:02d}", k): f"{n}/{k}".encode() for n, ks in ((3, [0, 1, 2]), (40, [0, 13, 26, 39])) for k in ks}
    assert frames.read_frames(chosen.limit(0)).count() == 0
    with pytest.raises(ValueError, match="fewer videos"):
        frames.read_frames(chosen, most=3)


def test_files_that_go_before_they_are_read_matter_only_if_chosen(spark, tmp_path):
    d = tmp_path / "v"
    d.mkdir()
    for k in range(9):
        (d / f"f{k}.jpg").write_bytes(b"x")
    chosen = frames.evenly_spaced(frames.frame_files(spark, str(tmp_path)), 3).collect()
    os.remove(d / "f3.jpg")
    df = spark.createDataFrame(chosen)
    assert [r.place for r in frames.read_frames(df).orderBy("place").collect()] == [0, 4, 8]
