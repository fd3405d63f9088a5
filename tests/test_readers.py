import json

import pytest
from pyspark.sql import functions as F

from corvane.sources.readers import GitLog, Transcripts


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(Transcripts)
    spark.dataSource.register(GitLog)


def line(n, text, kind="AssistantMessage"):
    return json.dumps({"kind": kind, "data": {"message_id": str(n), "content": [{"kind": "text", "data": text}, {"kind": "tool", "data": {}}]}}, ensure_ascii=False) + "\n"


@pytest.mark.parametrize("width", [1, 7, 64, 100, 1 << 20])
def test_ranges_lose_and_repeat_no_line(spark, tmp_path, width):
    texts = [f"é{'x' * (n * 7 % 90)}" for n in range(40)]
    (tmp_path / "a.jsonl").write_text("".join(line(n, t) for n, t in enumerate(texts[:25])) + "no json\n[1]\n{}\n\n" + "".join(line(n + 25, t) for n, t in enumerate(texts[25:]))[:-1])
    (tmp_path / "b.jsonl").write_text("")
    (tmp_path / "c.txt").write_text(line(1, "not read"))
    if width < 64:
        (tmp_path / "a.jsonl").write_text("".join(line(n, t) for n, t in enumerate(texts[:2])))
        texts = texts[:2]
    got = spark.read.format("transcripts").option("range", width).load(str(tmp_path)).collect()
    assert sorted((int(r.message_id), r.text, r.session, r.kind) for r in got) == [(n, t, "a", "AssistantMessage") for n, t in enumerate(texts)]
    assert len({r["at"] for r in got}) == len(texts)


def test_a_stream_resumes_without_loss_or_repeat(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run():
        s = spark.readStream.format("transcripts").option("range", 100).load(str(folder))
        q = s.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        return sorted((r.session, int(r.message_id)) for r in spark.read.parquet(out).collect())

    last = line(3, "three")
    (folder / "a.jsonl").write_text(line(1, "one") + line(2, "two") + last[:20])
    assert run() == [("a", 1), ("a", 2)]
    with open(folder / "a.jsonl", "a") as f:
        f.write(last[20:] + line(4, "four"))
    (folder / "b.jsonl").write_text(line(5, "five"))
    assert run() == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 5)]
    assert run() == [("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 5)]


@pytest.mark.parametrize("width", [5, 50, 1 << 20])
def test_commits_keep_their_files_in_any_range(spark, tmp_path, width):
    lines, want = [], []
    for n in range(12):
        lines.append(f"{n:040x}|2024-01-02 03:04:05 +0000|ann|fix: a|b {n}\n\n")
        stats = [(f"d/{n}/{k}.py", n, k) for k in range(n % 4)]
        lines += [f"{a}\t{r}\t{p}\n" for p, a, r in stats]
        want.append((f"{n:040x}", f"fix: a|b {n}", stats))
    lines.append("-\t-\tlogo.png\n")
    want[-1][2].append(("logo.png", 0, 0))
    (tmp_path / "x.log").write_text("".join(lines))
    got = spark.read.format("gitlog").option("range", width).load(str(tmp_path))
    assert sorted((r.hash, r.subject, [tuple(f) for f in r.files]) for r in got.collect()) == want
    assert got.select(F.explode("files.path")).count() == sum(len(w[2]) for w in want)


def test_a_folder_without_files(spark, tmp_path):
    assert spark.read.format("transcripts").load(str(tmp_path)).count() == 0
