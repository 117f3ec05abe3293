import random

import pytest

from postlens.sources import live


def drive(reader, start):
    """One batch: (offset, rows)."""
    end = reader.latestOffset()
    rows = [r for s in reader.partitions(start, end) for b in reader.read(s) for r in b.to_pylist()]
    return end, rows


def test_growing_files_in_bounded_batches(tmp_path):
    rnd = random.Random(2)
    reader = live.LiveReader({"path": str(tmp_path), "max_bytes": "200", "split_bytes": "37"})
    at, got, want, half = reader.initialOffset(), [], [], {}
    for step in range(60):
        for name in ("a.html", "b.html") if step < 40 else ():
            with (tmp_path / name).open("ab") as f:
                for _ in range(rnd.randrange(3)):
                    line = half.pop(name, b"") if name in half else b""
                    new = "".join(rnd.choice("xyé<&") for _ in range(rnd.choice([0, 5, 30, 90]))).encode()
                    f.write(new)
                    if rnd.random() < 0.7:
                        f.write(b"\n")
                        if (line + new).strip():
                            want.append((name, (line + new).decode()))
                    else:
                        half[name] = line + new
        before = dict(at)
        at, rows = drive(reader, at)
        got += [(r["file"], r["html"]) for r in rows]
        assert sum(at.values()) - sum(before.values()) <= 200 + 2 * 500
        if rnd.random() < 0.3:  # a restart after the batch was committed: the reader knows nothing
            reader = live.LiveReader({"path": str(tmp_path), "max_bytes": "200", "split_bytes": "50"})
            reader.taken = dict(at) if rnd.random() < 0.5 else None
    assert sorted(got) == sorted(want) and len(got) > 20
    assert [x for x in got if x[0] == "a.html"] == [x for x in want if x[0] == "a.html"]


def test_progress_keeps_admission_after_a_restart(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("12345\n" * 100)
    options = {"path": str(tmp_path / "in"), "max_bytes": "60", "progress": str(tmp_path / "progress")}
    at, rows = drive(first := live.LiveReader(options), first.initialOffset())
    assert at == {"a": 60} and len(rows) == 10 and rows[1]["page_id"] == "a:6"
    at, rows = drive(live.LiveReader(options), at)
    assert at == {"a": 120} and len(rows) == 10
    (tmp_path / "in" / "a").write_text("1\n")
    with pytest.raises(ValueError):
        live.LiveReader(options).latestOffset()


PAGE = '<main><div data-urn="urn:li:activity:{i}"><p>Sam</p><p>Engineer</p><span>5h</span><div class="update-components-text">We are hiring number {i} for a new team of builders.</div><button aria-label="Comment">3</button></div></main>\n'


def test_stream_of_posts_with_restarts(spark, tmp_path):
    (folder := tmp_path / "in").mkdir()
    seen = {}

    def sink(posts, epoch):
        seen[epoch] = [r.post_id for r in posts.select("post_id").collect()]

    def run():
        pages = live.live_pages(spark, str(folder), max_bytes="700", progress=str(tmp_path / "progress"))
        q = pages.writeStream.foreachBatch(live.posts_to(sink)).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        q.stop()
        assert q.exception() is None

    with (folder / "feed.html").open("a") as f:
        f.write("".join(PAGE.format(i=i) for i in range(100, 105)) + PAGE.format(i=105)[:50])
    run()
    assert sorted(x for v in seen.values() for x in v) == [f"urn:li:activity:{i}" for i in range(100, 105)] and len(seen) >= 2
    with (folder / "feed.html").open("a") as f:
        f.write(PAGE.format(i=105)[50:] + PAGE.format(i=106))
    run()
    run()
    assert sorted(x for v in seen.values() for x in v) == [f"urn:li:activity:{i}" for i in range(100, 107)]
