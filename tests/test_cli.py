import json

from tracewell import cli
from tracewell.human import render


def test_ingest_and_read(spark, tmp_path, capsys):
    folder, root = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "a.txt").write_text("1. First\nBody text, see Section 1.\f2. Second\nEnd.")
    (folder / "b.txt").write_bytes(b"\xff\xfe")
    (folder / "c.bin").write_bytes(b"x")
    ask = ["ingest", str(folder), root, "--run", "r1", "--parser", "text", "--suffix", ".txt"]
    assert cli.main(ask, spark) == 0
    rows = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert {r["path"].rsplit("/", 1)[1]: r["status"] for r in rows} == {"a.txt": "ingested", "b.txt": "failed", "c.bin": "skipped_unsupported_suffix"}
    assert cli.main(ask, spark) == 0  # the same again changes nothing
    capsys.readouterr()
    assert cli.main(["documents", root, "--run", "r1"], spark) == 0
    (row,) = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert row["blocks"] == 4
    assert cli.main(["--human", "artifact", root, "provenance", "--run", "r1"], spark) == 0
    assert "Section 1" in capsys.readouterr().out


def test_render():
    assert render({"a": 1, "b": [{"x": None, "y": True}, {"x": "long", "z": 2}], "c": []}) == "a: 1\nb:\n  x     y    z\n  -     yes  -\n  long  -    2\nc: -"
