import threading

from tidelog.__main__ import main
from tidelog.streaming import sinks

from .test_streaming import wait


def test_check_and_dump(capsys, tmp_path):
    assert main(["-t", "-q", "-c", "from timer; to stdout"]) == 0
    assert main(["-c", "from nowhere"]) == 1
    assert "`from` knows no such source: from nowhere [arg:1]" in capsys.readouterr().err
    path = tmp_path / "p.conf"
    path.write_text("flow{from timer}")
    assert main(["--dump-plan", "-f", str(path)]) == 0
    assert capsys.readouterr().out == "flow {\n    from timer;\n}\n"
    assert main(["-f", str(tmp_path / "none"), "-l", str(tmp_path / "log")]) == 1
    assert " ERROR " in (tmp_path / "log").read_text()


def test_run(spark):
    stop = threading.Event()
    sinks.MemorySink.rows("cli").clear()
    run = threading.Thread(target=main, args=(["-q", "-c", "from timer; set $payload 'tick $program'; to mock cli"], spark, stop))
    run.start()
    assert wait(lambda: sinks.MemorySink.rows("cli"))
    stop.set()
    run.join(30)
    assert set(sinks.MemorySink.rows("cli")) == {"tick tidelog"}
