from pagemill.__main__ import main


def test_actions_and_exit_codes(tmp_path, capfdbinary):
    def run(program: bytes, *more):
        (tmp_path / "p.ps").write_bytes(program)
        return main([*more[:1], str(tmp_path / "p.ps"), *more[1:]])

    assert run(b"1 2 add =", "run") == 0 and capfdbinary.readouterr().out == b"3\n"
    assert run(b"foo", "run") == 1 and b"undefined" in capfdbinary.readouterr().err
    assert run(b"{ } loop", "run", "--budget", "500") == 3
    assert run(b"0 0 1 1 rectfill showpage", "ir") == 0 and capfdbinary.readouterr().out.startswith(b"ir/1\npage 612 792\n")
    assert run(b"0 0 1 1 rectfill showpage", "pdf", str(tmp_path / "o.pdf"), "--no-compress") == 0
    assert (tmp_path / "o.pdf").read_bytes().startswith(b"%PDF-1.7")
    assert run(b"", "pdf") == 2 and main(["run", "/nowhere"]) == 2 and main(["what", "x"]) == 2


def test_flags(tmp_path, capfdbinary):
    (tmp_path / "a.ps").write_text("statusdict /jobname get = statusdict /n get = currentdistillerparams /EmbedAllFonts get = 0 0 1 1 rectfill showpage")
    found = main(["pdf", str(tmp_path / "a.ps"), str(tmp_path / "o.pdf"), "--identity", "jobname=(mine)", "--identity", "n=7", "--embed-all", "--no-subset", "--param", "CompatibilityLevel=1.5"])
    assert found == 0 and (tmp_path / "o.pdf").read_bytes().startswith(b"%PDF-1.5") and capfdbinary.readouterr().out == b"mine\n7\ntrue\n"
    assert main(["run", str(tmp_path / "a.ps"), "--identity", "nothing"]) == 2
