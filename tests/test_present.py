import os
import shutil
import time

import pytest

from aperture.sources.present import PresentSet
from aperture.sources.shared import Scratch


def make(root, *names):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_bytes(b"x")


def age(root):
    """All folders were changed long ago, each at a time of its own."""
    for k, (d, _, _) in enumerate(os.walk(root)):
        os.utime(d, (time.time() - 1000 - k, time.time() - 1000 - k))


def paths(p):
    return sorted(r.path for r in p.paths().collect())


def test_only_changed_folders_are_listed_again(spark, tmp_path):
    root = tmp_path / "images"
    make(root, "a/1.png", "a/2.png", "b/c/3.png", "4.png")
    age(root)
    p = PresentSet(spark, str(root), f"{tmp_path}/cache")
    assert p.refresh() == 4 and paths(p) == ["4.png", "a/1.png", "a/2.png", "b/c/3.png"]
    versions = lambda: len(list((tmp_path / "cache" / "_versions").iterdir()))
    assert p.refresh() == 0 and versions() == 1  # nothing listed, nothing written
    make(root, "b/c/5.png")  # one folder changes
    assert p.refresh() == 1 and "b/c/5.png" in paths(p)
    assert p.refresh() == 1  # a change of just now may not be the last of its moment
    age(root)
    p.refresh()
    make(root, "new/deep/6.png")
    (root / "a" / "1.png").unlink()
    assert p.refresh() == 4  # the root, a, and the two new ones
    assert paths(p) == ["4.png", "a/2.png", "b/c/3.png", "b/c/5.png", "new/deep/6.png"]
    age(root)
    p.refresh()
    shutil.rmtree(root / "b")
    assert p.refresh() == 1 and paths(p) == ["4.png", "a/2.png", "new/deep/6.png"]
    rows = spark.createDataFrame([(1, "a/1.png"), (2, "a/2.png"), (2, "a/2.png"), (3, None)], "k int, file string")
    assert [tuple(r) for r in p.only(rows, "file").collect()] == [(2, "a/2.png")] * 2


def test_an_empty_and_a_missing_root(spark, tmp_path):
    (tmp_path / "none").mkdir()
    p = PresentSet(spark, f"file://{tmp_path}/none", f"{tmp_path}/cache", settle=0)
    assert p.refresh() == 1 and paths(p) == [] and p.refresh() == 0
    missing = PresentSet(spark, f"{tmp_path}/missing", f"{tmp_path}/cache2")
    assert missing.refresh() == 0 and paths(missing) == []


def test_scratch_ends_with_its_block(spark):
    with Scratch(spark, "block") as scratch:
        assert scratch.table(spark.range(3), "t").count() == 3
        folder = scratch.root.removeprefix("file://")
        assert os.path.exists(folder)
    assert not os.path.exists(folder)
    with pytest.raises(ZeroDivisionError), Scratch(spark, "block") as scratch:
        scratch.table(spark.range(3), "t")
        folder = scratch.root.removeprefix("file://")
        1 / 0
    assert not os.path.exists(folder)
