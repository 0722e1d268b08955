"""Guards of paths against spellings that would leave the library."""

import posixpath

import pytest
from pyspark.sql import functions as F

from libraryloom.functions import paths

CASES = ["a/b.md", "a/./b.MD", "a//b.pdf", "../a.md", "a/../../b.md", "a/../b.md", "/etc/passwd", "", ".", "./", "a/..", "..", "a/..b/c.html", "a/b..md", ".md", "a/.md", "a.", "a/b.exe", "a\x00.md", "a/b.md/"]


@pytest.mark.parametrize("given", [*CASES, None])
def test_paths(spark, given):
    c = F.lit(given).cast("string")
    row = spark.range(1).select(paths.resolved(c), paths.inside(c), paths.viewable(c), paths.servable(c), paths.safe_name(c)).first()
    text = given or ""
    norm = posixpath.normpath(text) if text else "."
    want = None if given is None or text.startswith("/") or norm.startswith("..") and norm.split("/")[0] == ".." else "" if norm == "." else norm
    assert row[0] == want
    inside = bool(want) and ".." not in text.split("/") and "\x00" not in text
    suffix = posixpath.splitext(want or "")[1]
    assert row[1:4] == (inside, inside and suffix == ".md", inside and suffix.lower()[1:] in paths.SERVED)
    assert row[4] == (text not in ("", ".", "..") and not set(text) & set("/\x00\n\r"))
