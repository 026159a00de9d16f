"""Growing log files: only new lines, the last lines of new and cut files, restarts, peeks."""

import random

import pytest

from sitemill.streaming import logtail
from sitemill.streaming.logtail import Files


@pytest.fixture
def scan(spark, tmp_path):
    (tmp_path / "logs" / "deep").mkdir(parents=True)

    def run(**options):
        lines = logtail.tail(spark, f"{tmp_path}/logs", **options)
        logtail.write_scans(lines, f"{tmp_path}/out", f"{tmp_path}/checkpoint", once=True).awaitTermination()
        rows = logtail.read_scans(spark, f"{tmp_path}/out").collect()
        return {(r.scan, r.bundle_name, r.message) for r in rows}

    return run


def test_an_old_error_is_not_repeated_and_new_content_is_read(scan, tmp_path):
    log = tmp_path / "logs" / "run.log"
    log.write_text("normal line\n[ERROR] first boom in bundle demo\n")
    first = {(0, "unknown_bundle", "[ERROR] first boom in bundle demo")}
    assert scan() == first
    assert scan() == first  # nothing was appended: no batch
    with open(log, "a") as f:
        f.write("[ERROR] second boom in bundles/demo/x.py\r\nfine\n[ERROR] second boom in bundles/demo/x.py\n[ERROR] unfini")
    second = first | {(1, "demo", "[ERROR] second boom in bundles/demo/x.py")}
    assert scan() == second
    with open(log, "a") as f:
        f.write("shed\n")
    (tmp_path / "logs" / "deep" / "other.log").write_text("KeyError\n")
    (tmp_path / "logs" / "notes.txt").write_text("[ERROR] no log\n")
    assert scan() == second | {(2, "unknown_bundle", "[ERROR] unfinished"), (2, "unknown_bundle", "KeyError")}


def test_new_and_cut_files_give_their_last_lines(scan, tmp_path):
    log = tmp_path / "logs" / "run.log"
    log.write_text("".join(f"[ERROR] old {i}\n" for i in range(1_000)))
    assert {m for _, _, m in scan()} == {f"[ERROR] old {i}" for i in range(700, 1_000)}
    log.write_text("".join(f"[ERROR] rotated {i}\n" for i in range(400)))
    assert {m for s, _, m in scan() if s == 1} == {f"[ERROR] rotated {i}" for i in range(100, 400)}
    log.write_text("")
    assert not any(s == 2 for s, _, _ in scan())


def test_peek_moves_nothing_and_a_restart_goes_on(spark, scan, tmp_path):
    log, seen = tmp_path / "logs" / "run.log", lambda: {r.message for r in logtail.scan_errors(logtail.peek(spark, f"{tmp_path}/logs", f"{tmp_path}/checkpoint")).collect()}
    log.write_text("[ERROR] a\n")
    assert seen() == seen() == {"[ERROR] a"}
    assert {m for _, _, m in scan()} == {"[ERROR] a"} and seen() == set()
    with open(log, "a") as f:
        f.write("[ERROR] b\n")
    assert seen() == {"[ERROR] b"}
    # The batch is written, its commit is lost: the same bytes are read again into the same place.
    scan()
    for name in ("1", ".1.crc"):
        (tmp_path / "checkpoint" / "commits" / name).unlink()
    with open(log, "a") as f:
        f.write("[ERROR] c\n")
    both = {(0, "unknown_bundle", "[ERROR] a"), (1, "unknown_bundle", "[ERROR] b")}
    assert scan() == both  # a run that repeats a batch ends with it
    assert scan() == both | {(2, "unknown_bundle", "[ERROR] c")}


def test_ranges_put_together_give_every_line_once(tmp_path):
    rng = random.Random(1)
    for n in range(40):
        lines = [bytes(rng.choice(b"abc\r\xc3\xa9\xff ") for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(rng.randrange(0, 60))]
        data = b"".join(line + b"\n" for line in lines) + rng.choice([b"", b"open"])
        path = tmp_path / f"{n}.log"
        path.write_bytes(data)
        files = Files({"path": str(tmp_path), "pattern": path.name, "rangeBytes": str(rng.choice([1, 3, 7, 50])), "lines": "10"})
        end = files.latest()
        want = [line.removesuffix(b"\r").decode("utf-8", "ignore") for line in lines]
        starts = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
        rows = lambda since: [(a, v) for p in files.between(since, end) for b in files.read(p) for a, v in zip(b["at"].to_pylist(), b["value"].to_pylist())]
        assert rows({str(path): 0}) == list(zip(starts, want))
        assert rows({}) == list(zip(starts, want))[-10:]
        if lines:
            k = rng.randrange(len(lines))
            assert rows({str(path): starts[k]}) == list(zip(starts, want))[k:]
            assert files.between({str(path): starts[k]}, end) and not files.between(end, end)


def test_short_files_share_tasks_and_long_ones_are_parted(tmp_path):
    for n in range(200):
        (tmp_path / f"{n:03}.log").write_text(f"a {n}\nb {n}\n")
    (tmp_path / "long.log").write_text("x" * 99 + "\n" + "y" * 2_000_000 + "\nz\n")
    files = Files({"path": str(tmp_path), "rangeBytes": str(1 << 20)})
    end = files.latest()
    assert len(end) == 201
    size = end[str(tmp_path / "long.log")]
    wide = Files({"path": str(tmp_path), "rangeBytes": str(32 << 20)})
    for since in ({}, dict.fromkeys(end, 0)):
        shares = wide.between(since, end)
        assert len(shares) <= 5
        values = [v for p in shares for b in wide.read(p) for v in b["value"].to_pylist()]
        assert values[:4] == ["a 0", "b 0", "a 1", "b 1"] and len(values) == 403
    shares = files.between(dict.fromkeys(end, 0), end)
    assert sum(any(p.path.endswith("long.log") for p in s.pieces) for s in shares) >= size >> 20
    assert sum(b.num_rows for p in shares for b in files.read(p)) == 403
