"""Verdict drops in keyed state against the batch reading of the same lines."""

import json

from bibloom.sources import readers
from bibloom.streaming import verdicts


def line(index, verdict="include", t="a title", **kw):
    return json.dumps({"index": index, "t": t, "verdict": verdict, **kw})


DROPS = [
    [line(1), line(2, "exclude", reason="off"), "not json", line("3", "unsure", role="review"), line(1, "exclude"), ""],
    [line(2, "maybe"), line(True, "include", role="bard"), line(4, t=None), "[]", line(None)],
    [line(3, "include"), line(2, "exclude", reason="off"), line(4.5), '{"index": 5}', line(1, "unsure", reason="ü x")],
]


def table(df):
    return sorted((r["index"], r.t, r.verdict, r.reason, r.role) for r in df.collect())


def test_state_equals_the_batch_after_every_drop_and_run(spark, tmp_path):
    root, seen = str(tmp_path), []
    (tmp_path / "in").mkdir()
    for k, lines in enumerate(DROPS):
        (tmp_path / "in" / f"d{k}.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
        verdicts.fold(spark, f"{root}/in", f"{root}/changes", f"{root}/state")
        seen += lines
        (tmp_path / f"all{k}.jsonl").write_text("\n".join(seen) + "\n", encoding="utf-8")
        assert table(verdicts.latest(spark, f"{root}/state")) == table(readers.read_verdicts(spark, f"{root}/all{k}.jsonl"))
    # a drop gives a row for what it changes and for nothing else
    told = sorted((r.drop, r["index"], r.before, r.verdict) for r in verdicts.changed(spark, f"{root}/changes").collect())
    assert told == [(0, 1, "", "exclude"), (0, 2, "", "exclude"), (0, 3, "", "unsure"), (1, 1, "exclude", "include"), (1, 4, "", "include"), (2, 1, "include", "unsure"), (2, 3, "unsure", "include")]
    verdicts.fold(spark, f"{root}/in", f"{root}/changes", f"{root}/state")  # nothing new
    assert verdicts.changed(spark, f"{root}/changes").count() == len(told)


def test_files_that_arrive_together_count_by_name(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.jsonl").write_text(line(1, "exclude") + "\n")
    (tmp_path / "in" / "a.jsonl").write_text(line(1, "include") + "\n" + line(2) + "\n")
    verdicts.fold(spark, f"{root}/in", f"{root}/changes", f"{root}/state")
    assert [r[2] for r in table(verdicts.latest(spark, f"{root}/state"))] == ["exclude", "include"]
