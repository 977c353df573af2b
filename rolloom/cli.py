"""python -m rolloom.cli: run, resume, status, inspect, export, evolve, init-domain. Exit 2: bad arguments, 1: it failed."""

from __future__ import annotations

import argparse
import re
import sys
from pathlib import Path

from pyspark.sql import functions as F

from rolloom import domains
from rolloom.operators import export, logs
from rolloom.operators.evolve import Harness
from rolloom.sources import config as settings

TEMPLATE = '''"""The domain {name}."""

from pyspark.sql import SparkSession

from rolloom.domains.base import Domain, chat, register
from rolloom.sources.grounding import from_files


@register
class {cls}(Domain):
    name = "{name}"

    def grounding(self, spark: SparkSession):
        return from_files(spark, self.params.get("docs_path", "."))

    def generation_prompt(self, item, feedback, round_n, prior):
        return chat("TASK:propose. ...", item["body"])

    def validate(self, candidate):
        return []  # texts on what is wrong

    def solver_prompt(self, candidate):
        return chat("TASK:solve. ...", str(candidate["payload"]))

    def quality_prompt(self, candidate):
        return chat("TASK:check. ...", str(candidate["payload"]))

    def judge_prompt(self, candidate, answer):
        return chat("TASK:score. ...", answer)
'''


def camel(name: str) -> str:
    return "".join(p[:1].upper() + p[1:] for p in re.split(r"[_\W]+", name) if p)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rolloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("run")
    a.add_argument("--config", required=True)
    a.add_argument("--run-id")
    a.add_argument("--resume", action=argparse.BooleanOptionalAction, default=None)
    a = sub.add_parser("evolve")
    a.add_argument("--config", required=True)
    a.add_argument("--rng-seed", type=int)
    for name in ("resume", "status", "inspect"):
        a = sub.add_parser(name)
        a.add_argument("run_dir")
        if name == "resume":
            a.add_argument("--config")
        if name == "inspect":
            a.add_argument("--stuck", action="store_true")
    a = sub.add_parser("export")
    a.add_argument("run_dir")
    a.add_argument("--format", choices=("jsonl", "parquet", *export.FORMATS), default="jsonl")
    a.add_argument("--to", choices=("jsonl", "parquet"), default="jsonl")
    a.add_argument("--out")
    a.add_argument("--completion", choices=("reference", "best-strong"), default="reference")
    for name, v in (("--min-score", 0.75), ("--min-chosen", 0.75), ("--min-margin", 0.30)):
        a.add_argument(name, type=float, default=v)
    a.add_argument("--no-meta", action="store_true")
    a.add_argument("--no-card", action="store_true")
    a = sub.add_parser("init-domain")
    a.add_argument("name")
    a.add_argument("--out", default=".")
    return p


def open_run(spark, run_dir: str):
    from rolloom.operators.store import RunStore

    if not Path(run_dir).is_dir():
        raise FileNotFoundError(run_dir)
    store = RunStore(spark, run_dir)
    row = store.run()
    if row is None:
        raise RuntimeError(f"no run in {run_dir}")
    return store, row


def export_run(spark, run_dir: str, fmt: str, to: str = "jsonl", out: str | None = None, guards: export.Guards = export.Guards(), meta: bool = True, card: bool = True) -> int:
    """Writes a training set of the run's accepted records; their number."""
    from dataclasses import replace

    store, row = open_run(spark, run_dir)
    target = out or f"{run_dir}/exports/{fmt}" + (".jsonl" if to == "jsonl" else "")
    if fmt in ("jsonl", "parquet"):
        raw = store.accepted().orderBy("accepted_seq", "item_id")
        if fmt == "parquet":
            return export.write(raw.drop("payload"), out or f"{run_dir}/exports/accepted", "parquet")
        path = Path(out or f"{run_dir}/exports/accepted.jsonl")
        path.parent.mkdir(exist_ok=True, parents=True)
        with open(path, "w", encoding="utf-8") as f:
            return sum(bool(f.write(r["payload"] + "\n")) for r in raw.select("payload").toLocalIterator())
    c = settings.load_snapshot(f"{run_dir}/config.snapshot.yaml")
    domain = domains.build(c.domain.name, c.domain.path, c.domain.params)
    verifiable = (c.acceptance.mode or domain.mode) == "verifiable"
    guards = replace(guards, verifiable=verifiable)
    needs = (fmt, guards.completion if fmt == "sft" else "") in (("dpo", ""), ("sft", "best-strong"))
    static = {
        "mode": F.lit("verifiable" if verifiable else c.acceptance.mode or domain.mode),
        "models": F.to_json(F.create_map(*(F.lit(x) for r in ("challenger", "weak", "strong", "judge", *(["audit"] if c.audit.enabled else [])) for x in (r, c.model(r).provider_model)))),
        "rules": F.lit(Harness.from_json(row["harness"]).fingerprint() if row["harness"] else ""),
    }
    about = F.struct("run_id", "item_id", "source_id", "domain", "refinement_round", "weak_avg", "strong_avg", "gap", "rationale", F.col("audit.passed").alias("audit_passed"), *(v.alias(k) for k, v in static.items()))
    rows = export.build(store.accepted().drop("payload"), fmt, guards, store.truncated() if needs else None, about if meta else None)
    text = export.card(fmt, row["run_id"], rows.count(), domain.name, verifiable) if card else None
    return export.write(rows, target, to, text)


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    if a.command == "init-domain":
        target = Path(a.out) / f"{a.name}.py"
        if target.exists():
            print(f"{target} exists", file=sys.stderr)
            return 1
        target.parent.mkdir(exist_ok=True, parents=True)
        target.write_text(TEMPLATE.format(name=a.name, cls=camel(a.name)))
        print(target)
        return 0
    try:
        from rolloom.runner import Runner, batch_provider_for
        from rolloom.session import local_session

        if a.command in ("run", "evolve"):
            c = settings.load(a.config)
        spark = spark or local_session()
        if a.command == "run":
            from dataclasses import replace

            c = c if a.resume is None else replace(c, resume=a.resume)
            print(Runner(spark, c, run_id=a.run_id, batch_provider=batch_provider_for(c)).run())
        elif a.command == "evolve":
            from rolloom.optimizer import Optimizer

            print(Optimizer(spark, c, a.rng_seed).run())
        elif a.command == "resume":
            from dataclasses import replace

            store, row = open_run(spark, a.run_dir)
            c = settings.load(a.config) if a.config else settings.load_snapshot(f"{a.run_dir}/config.snapshot.yaml")
            c = replace(c, output_dir=str(Path(a.run_dir).parent), resume=True)
            h = Harness.from_json(row["harness"]) if row["harness"] else Harness()
            print(Runner(spark, c, run_id=row["run_id"], harness=h, batch_provider=batch_provider_for(c)).run())
        elif a.command == "export":
            g = export.Guards(completion=a.completion, min_score=a.min_score, min_chosen=a.min_chosen, min_margin=a.min_margin)
            print(export_run(spark, a.run_dir, a.format, a.to, a.out, g, not a.no_meta, not a.no_card), "rows")
        else:
            store, row = open_run(spark, a.run_dir)
            print(row["run_id"], row["status"], f"{store.cost():.4f} USD")
            logs.state_counts(store.items()).orderBy("state").show()
            if a.command == "inspect":
                (logs.stuck(store.items()) if a.stuck else store.items().select("item_id", "source_id", "state", "current_round").orderBy("item_id")).show(1000, 80)
    except (OSError, ValueError, RuntimeError, KeyError, TypeError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
