import pytest

from tidelog.functions.templates import TemplateError, parse_template
from tidelog.plans import commands as c
from tidelog.plans.language import ConfigError, tokens


def canonical(text):
    return c.read_program(text, "t").canonical()


def error(text):
    with pytest.raises(ConfigError) as e:
        c.read_program(text, "t")
    return str(e.value)


@pytest.mark.parametrize("text,parts", [
    ("plain words", ["plain words"]), ("", [""]), ("$user", ["", "user"]), ("{$user}", ["", "user"]), ("$_tag2", ["", "_tag2"]),
    ("from $host to $peer.", ["from ", "host", " to ", "peer", "."]), ("{$year}y{$month}m", ["", "year", "y", "month", "m"]),
    ("$left$right", ["", "left", "", "right"]), ("{$left}$right", ["", "left", "", "right"]), ("id={$id}0", ["id=", "id", "0"]),
    (r"price \$5 of $item", ["price $5 of ", "item"]), (r"c:\\$dir", ["c:\\", "dir"]), (r"\{$id}", ["{", "id", "}"]),
    ("{no field}", ["{no field}"]), ("{x$id}", ["{x", "id", "}"]), (r"one\ttwo\r\n", ["one\ttwo\r\n"]), ("total $", ["total $"]), ("open {", ["open {"]),
    ("größe $id→", ["größe ", "id", "→"]),
])
def test_template(text, parts):
    assert list(parse_template(text).parts) == parts


@pytest.mark.parametrize("text,message", [
    ("owes $9", "a field's name can't begin with '9', at 6 in: owes $9"), ("{$-id}", "a field's name can't begin with '-', at 2 in: {$-id}"),
    ("50$ off", "a field's name can't begin with ' ', at 3 in: 50$ off"), ("{$id or}", "a field's name can't hold ' ', at 4 in: {$id or}"),
])
def test_bad_template(text, message):
    with pytest.raises(TemplateError) as e:
        parse_template(text)
    assert str(e.value) == message


def test_template_references():
    assert parse_template("<$2 ${name}> by $user", references=True).parts == ("<$2 ${name}> by ", "user")


@pytest.mark.parametrize("text,out", [
    ("drop", "drop;\n"), ("tee{}", "tee;\n"), ("tee { }", "tee;\n"), ("  keep   $host\n\t$program ;", "keep $host $program;\n"),
    ("# first\nparse json; # second; third\nto stdout", "parse json;\nto stdout;\n"), ("tee {to mock a}", "tee {\n    to mock a;\n}\n"),
    ("set $line replace ~\\d+~i \"#\" in '$a;$b'", "set $line replace ~\\d+~i \"#\" in '$a;$b';\n"),
    ("join{flow{from udp 9;drop}}drop", "join {\n    flow {\n        from udp 9;\n        drop;\n    }\n}\ndrop;\n"),
    ("switch '$host/$program' { case ~^db~ {keep $host; to mock} default }", "switch '$host/$program' {\n    case ~^db~ {\n        keep $host;\n        to mock;\n    }\n    default;\n}\n"),
])
def test_canonical(text, out):
    assert canonical(text) == out
    assert canonical(out) == out


@pytest.mark.parametrize("text,message", [
    ("from timer soon", "`from timer` wants a whole number of seconds above zero: from timer soon [t:1]"),
    ("from timer 0 seconds", "`from timer` wants a whole number of seconds above zero: from timer 0 seconds [t:1]"),
    ("drop\n;\nfrom timer 5 minutes", "`from` takes nothing more after that: from timer 5 minutes [t:3]"),
    ("to stdout twice", "`to` takes nothing more after that: to stdout twice [t:1]"), ("tee both {drop}", "`tee` takes nothing more after that: tee both [t:1]"),
    ("rotate $host", "`rotate` can't stand in the program: rotate $host [t:1]"), ("tee {\n  buffer {}}", "`buffer` can't stand in `tee`: buffer [t:2]"),
    ("drop {to stdout}", "`to` can't stand in `drop`: to stdout [t:1]"), ("switch $a {drop}", "`drop` can't stand in `switch`: drop [t:1]"),
    ("from udp 70000", "'70000' is no address; write port or host:port: from udp 70000 [t:1]"), ("to tcp db_1:x", "'db_1:x' is no address; write port or host:port: to tcp db_1:x [t:1]"),
    ("to udp $peer:514", "`to udp` wants a port to send to, without message fields: to udp $peer:514 [t:1]"), ("from tcp", "`from tcp` wants a port to listen on: from tcp [t:1]"),
    ("from tcp 9 as json", "the only other framing of `from tcp` is `as syslog-frame`: from tcp 9 as json [t:1]"), ("from pipe", "`from` knows no such source: from pipe [t:1]"),
    ("drop; set $a \"open", 'the string has no end: "open [t:1]'), ("parse ~(a|b)", "the regular expression has no end: ~(a|b) [t:1]"), ("parse ~a~iz", "regular expressions have no modifier z [t:1]"),
    ("set $a replace 'b' 'c'", "`replace` wants a ~regular expression~: set $a replace 'b' 'c' [t:1]"), ("set $a replace ~b~ 'c' in", "`replace` wants a text after `in`: set $a replace ~b~ 'c' in [t:1]"),
    ("set host x", "`set` wants a field first, such as $payload: set host x [t:1]"), ("set $host", "`set` wants a value for the field: set $host [t:1]"),
    ("keep", "`keep` wants the fields to keep: keep [t:1]"), ("keep $host program", "`keep` takes fields only: keep $host program [t:1]"),
    ("set $line json host", "`json` takes fields only: set $line json host [t:1]"),
    ("switch {}", "`switch` wants a text to compare: switch [t:1]"), ("switch $a {default\n;case x}", "`default` must be the last branch: case x [t:2]"),
    ("switch $a {default;default}", "`default` can stand once: default [t:1]"), ("switch $a {case}", "`case` wants a text or a ~regular expression~: case [t:1]"),
    ("parse", "`parse` wants a format or a ~regular expression~: parse [t:1]"), ("parse csv", "`parse` knows no such format: parse csv [t:1]"),
    ("parse ~ a ~x", "`parse` can't take a regular expression with the modifier x: parse ~ a ~x [t:1]"),
    ("to printer", "`to` knows no such sink: to printer [t:1]"), ("create_dates_in_timezone Mars/Base", "there is no time zone Mars/Base: create_dates_in_timezone Mars/Base [t:1]"),
    ("queue_chunk_messages few", "a whole number is wanted (k, m and g multiply by 1024): queue_chunk_messages few [t:1]"),
    ("buffer {memory_compression zip}", "zip is no compression; it is off or fast: memory_compression zip [t:1]"), ("buffer; buffer", "`buffer` can stand once: buffer [t:1]"),
    ("tee {drop}}", "a brace closes that none has opened [t:1]"), ("{drop}", "a brace opens without a command [t:1]"), ("drop;;", "a semicolon ends no command [t:1]"),
    ("'drop'", "a command can't begin with 'drop' [t:1]"), ("tee {drop", "the text ends within a block [t]"),
    ("set $d date as 'yyyy w'", "a date pattern can't hold the letter w: set $d date as 'yyyy w' [t:1]"), ("set $d date as 'V'", "no such letters of a zone in a date pattern: V: set $d date as 'V' [t:1]"),
])
def test_errors(text, message):
    assert error(text) == message


def test_invalid_regexp_is_told_by_java(spark):
    with pytest.raises(ConfigError, match=r"(?s)^This regular expression doesn't compile: Unclosed group near index 5.* \[t:2\]$"):
        c.read_program("drop;\nparse ~(?<a>~", "t", spark=spark)


def test_framing_conflict():
    assert error("from tcp h:7; tee {from tcp h:7 as syslog-frame}") == "h:7 is read as lines in one place and as syslog-frame in another [t]"


def test_options():
    o = c.read_program("queue_chunk_messages 1k; create_dates_in_timezone Europe/Berlin; prometheus_metrics_http_address 8080; buffer {memory_bytes 2m; memory_compression off} from timer").options
    assert (o.queue_chunk_messages, o.zone, o.prometheus, o.buffer_bytes, o.compression) == (1024, "Europe/Berlin", ("0.0.0.0", 8080), 2 << 20, "off")


def test_tokens_end_within_words():
    assert [t.text for t in tokens("a;b{c'd'~e~i}")] == ["a", ";", "b", "{", "c", "'d'", "~e~i", "}"]
    assert tokens(r"'a\'b\n'")[0].fixed == "a'b\n"


def test_dialect_names_the_stats_parser():
    assert c.read_program("parse my-stats", dialect=c.Dialect("my-stats")).body[0].kind == "stats"
