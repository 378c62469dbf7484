"""Small objects in files."""

import pytest

from pairloom.sources import streams


def test_objects_come_back(tmp_path):
    data = {"a": [1, 2.5, None, "é"], "b": {"c": True}}
    path = f"file:{tmp_path}/x.json"
    streams.write_object(data, path, "json")
    assert streams.read_object(path, "json") == data
    streams.write_object("plain words", f"{tmp_path}/x.txt")
    assert (tmp_path / "x.txt").read_text() == "plain words\n"
    try:
        import yaml  # noqa: F401
    except ImportError:
        with pytest.raises(OSError):
            streams.write_object(data, f"{tmp_path}/x.yaml", "yaml")
    else:
        streams.write_object(data, f"{tmp_path}/x.yaml", "yaml")
        assert streams.read_object(f"{tmp_path}/x.yaml") == data
    for call in (lambda: streams.write_object(data, path, "xml"), lambda: streams.read_object(path, "plain")):
        with pytest.raises(RuntimeError):
            call()
