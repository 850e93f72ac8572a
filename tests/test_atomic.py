"""A single file is replaced in one step."""

from sluicework.sources import sinks


def test_a_file_is_put_in_place_and_replaced(spark, tmp_path):
    path = tmp_path / "report.md"
    for content in (b"first", b"second \xc3\xa9", b""):
        sinks.write_atomic(spark, str(path), content)
        assert path.read_bytes() == content
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["report.md"]
