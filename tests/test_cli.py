from siftwell.cli import main


def test_command_line(spark, tmp_path, capsys):
    root, index = tmp_path / "src", str(tmp_path / "ix")
    root.mkdir()
    (root / "a.txt").write_text("one\nTwo hit\nthree\nhit hit\n")
    (root / "b.md").write_text("no\n  HIT\n")
    (root / ".h").write_text("hit\n")

    def run(*argv, code=0):
        assert main([*argv], spark) == code
        return capsys.readouterr().out.splitlines()

    assert run("hit", str(root)) == ["a.txt:2:Two hit", "a.txt:4:hit hit"]
    assert run("hit", str(root), "-i", "--trim", "--heading") == ["a.txt", "2:Two hit", "4:hit hit", "b.md", "2:HIT"]
    assert run("hit", str(root), "--hidden", "-l") == [".h", "a.txt"]
    assert run("hit", str(root), "-c") == ["a.txt:2"]
    assert run("hit", str(root), "-o") == ["a.txt:2:hit", "a.txt:4:hit", "a.txt:4:hit"]
    assert run("hit", str(root), "-v", "--type", "txt") == ["a.txt:1:one", "a.txt:3:three"]
    assert run("three", str(root), "-B", "1") == ["a.txt-2-Two hit", "a.txt:3:three"]
    assert run("hit", str(root), "-q") == [] and run("zzz", str(root), "-q", code=1) == []
    assert run(code=2) == [] and run("(", str(root), code=1) == []
    assert run("--do", "index", str(root), "--index", index, "-i") == ["3 documents"]
    assert run("hit", str(root), "--index", index, "-i", "-c") == ["3"]
    (root / "c.txt").write_text("hit again\n")
    assert run("--do", "update", str(root), "--index", index) == ["1 added, 0 modified, 0 deleted, 4 documents"]
    assert run("again", str(root), "--index", index) == ["c.txt:1:hit again"]
    assert run("--do", "compact", "--index", index) == [] and "4 documents" in run("--do", "stats", "--index", index)[0]
