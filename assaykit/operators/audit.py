"""Audit logs: hash chains, control coverage, suite locks, evidence packages."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered

GENESIS = "0" * 64
CHAIN_VERSION = 1


def payload_hash(payload: dict) -> str:
    """SHA-256 of the compact JSON in its own key order, without the record's hash."""
    rest = {k: v for k, v in payload.items() if k != "record_hash"}
    return hashlib.sha256(_compact(rest).encode()).hexdigest()


def chained(payloads: list[dict], prev: str = GENESIS) -> list[str]:
    """Log lines for the payloads of one append, linked to the log's last hash."""
    return linked([chain_head(p) for p in payloads], prev)


_compact = json.JSONEncoder(separators=(",", ":")).encode


def chain_head(payload: dict) -> str:
    """A log line up to the hash before it, which is all that needs the line before: heads can be made in many tasks."""
    p = {**{k: v for k, v in payload.items() if k not in ("prev_hash", "record_hash")}, "chain_version": CHAIN_VERSION}
    return _compact(p)[:-1] + ',"prev_hash":"'


def linked(heads: Iterable[str], prev: str = GENESIS) -> list[str]:
    """Log lines of heads in order: a hash each, nothing is encoded anew."""
    lines, sha = [], hashlib.sha256
    for head in heads:
        body = f'{head}{prev}"'
        prev = sha(f"{body}}}".encode()).hexdigest()
        lines.append(f'{body},"record_hash":"{prev}"}}')
    return lines


def heads(payload: Column) -> Column:
    """Heads of log lines of payloads in JSON."""

    @F.pandas_udf("string")
    def run(c: pd.Series) -> pd.Series:
        return c.map(lambda p: chain_head(json.loads(p)))

    return run(payload)


def links(line: int = 0, prev: str = GENESIS) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over one partition's heads in order: line_no, value. A chain is written by one task, which streams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, before = line, prev
        for pdf in batches:
            lines = linked(pdf["head"], before)
            if lines:
                before = lines[-1][-66:-2]
                yield pd.DataFrame({"line_no": range(at, at + len(lines)), "value": lines})
                at += len(lines)

    return run


def verify_chain(lines: DataFrame) -> DataFrame:
    """line_no, record_id, verdict of (line_no, value): ok, legacy, tampered, chain_broken or unreadable.

    A record's hash is its own affair; the link is a lag: the record before gives
    its recomputed hash if that is what it stores, else the genesis hash.
    Unreadable lines are not links.
    """

    @F.pandas_udf("struct<record_id:string,stored:string,again:string,prev:string,chained:boolean>")
    def read(c: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in c:
            try:
                p = json.loads(raw)
                rows.append((str(p.get("record_id", "?")), p.get("record_hash"), payload_hash(p), p.get("prev_hash"), p.get("chain_version") is not None))
            except (ValueError, AttributeError, TypeError):
                rows.append((None, None, None, None, None))
        return pd.DataFrame(rows, columns=["record_id", "stored", "again", "prev", "chained"])

    x = lines.select("line_no", read("value").alias("r")).select("line_no", "r.*")
    intact = F.coalesce(F.col("stored") == F.col("again"), F.lit(False))
    good = x.where("again is not null").withColumn("intact", intact).withColumn("gives", F.when(intact, F.col("again")).otherwise(GENESIS))
    # A lag over the whole log, as a join of neighbouring numbers: ranges of lines are numbered apart.
    placed = numbered(good, "line_no", name="nth")
    before = placed.select((F.col("nth") + 1).alias("nth"), F.col("gives").alias("last"))
    linked = placed.join(before, "nth", "left").withColumn("expected", F.coalesce("last", F.lit(GENESIS)))
    verdict = F.when(~F.col("intact"), "tampered").when(~F.col("chained"), "legacy").when(F.coalesce(F.col("prev") == F.col("expected"), F.lit(False)), "ok").otherwise("chain_broken")
    return linked.select("line_no", "record_id", verdict.alias("verdict")).unionByName(x.where("again is null").select("line_no", "record_id", F.lit("unreadable").alias("verdict")))


def control_coverage(controls: DataFrame, mapping: DataFrame, evaluators: DataFrame) -> DataFrame:
    """control_id, evaluators, covered: which of a suite's evaluators back each control."""
    used = mapping.join(evaluators.select("evaluator").distinct(), "evaluator", "left_semi")
    by = used.groupBy("control_id").agg(F.array_sort(F.collect_set("evaluator")).alias("evaluators"))
    return controls.join(by, "control_id", "left").withColumn("covered", F.col("evaluators").isNotNull())


def unmapped(mapping: DataFrame, evaluators: DataFrame) -> DataFrame:
    return evaluators.select("evaluator").distinct().join(mapping, "evaluator", "left_anti")


def case_digests(cases: DataFrame) -> DataFrame:
    """case_index and digest of canonical JSON (sorted keys) of context, expected_output and input."""
    canon = F.to_json(F.struct("context", "expected_output", "input"), {"ignoreNullFields": "false"})
    return cases.select("case_index", F.sha2(canon, 256).alias("digest"))


def cases_hash(cases: DataFrame, width: int = 4096) -> DataFrame:
    """One hash of all cases in order: digests hash per block of cases, block hashes hash in order, so no task holds all cases."""
    return ordered_hash(case_digests(cases), "case_index", width).select(F.col("n").alias("cases"), F.col("hash").alias("cases_hash"))


def ordered_hash(rows: DataFrame, order: str, width: int = 4096) -> DataFrame:
    """n and hash of rows (order, from 0 on, and digest): blocks of ``width`` rows hash apart, then the blocks' hashes in order."""
    d = rows.withColumn("block", F.floor(F.col(order) / width))
    fold = lambda c, o: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o, c))), lambda s: s[c]), "\n"), 256)
    by = d.groupBy("block").agg(fold("digest", order).alias("digest"), F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), fold("digest", "block").alias("hash"))


def lock(evaluators: list[dict], cases: str | None, judge: dict | None = None) -> dict:
    """Hashes that pin a suite: each evaluator's settings, the judge, the cases."""
    sha = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return {"evaluators": {e["name"]: sha(e) for e in evaluators}, "judge": sha(judge or {}), "cases": cases}


def lock_diff(saved: dict, now: dict) -> list[str]:
    """What differs between two locks, in words."""
    old, new = saved["evaluators"], now["evaluators"]
    said = [f"evaluator {n} was removed" for n in sorted(old.keys() - new.keys())] + [f"evaluator {n} was added" for n in sorted(new.keys() - old.keys())]
    said += [f"evaluator {n} changed" for n in sorted(old.keys() & new.keys()) if old[n] != new[n]]
    return said + [f"{k} changed" for k in ("judge", "cases") if saved[k] != now[k]]


#: A programme without dependencies that checks a package it lies in.
VERIFIER = '''import hashlib, json, pathlib, sys

here = pathlib.Path(sys.argv[1] if len(sys.argv) > 1 else __file__).resolve()
here = here.parent if here.is_file() else here
want = json.loads((here / "manifest.json").read_text())
bad = [n for n, sha in want.items() if not (here / n).is_file() or hashlib.sha256((here / n).read_bytes()).hexdigest() != sha]
print("\\n".join(f"changed or missing: {n}" for n in bad) or "all files are as packed")
sys.exit(bool(bad))
'''


def host_facts() -> dict[str, str]:
    """Package, Python and platform of the process that writes a record."""
    import platform

    import pyspark

    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "system": platform.system().lower()}


def git_facts(folder: str) -> dict[str, str]:
    """Commit and branch of a working copy, from its files alone; nothing where there is none."""
    from pathlib import Path

    at = next((p for p in (Path(folder).resolve(), *Path(folder).resolve().parents) if (p / ".git").is_dir()), None)
    if at is None:
        return {}
    head = (at / ".git" / "HEAD").read_text().strip()
    if not head.startswith("ref: "):
        return {"commit": head}
    name, own = head[5:], at / ".git" / head[5:]
    packed = at / ".git" / "packed-refs"
    found = own.read_text().strip() if own.is_file() else next((x.split()[0] for x in packed.read_text().splitlines() if x.endswith(" " + name)), "") if packed.is_file() else ""
    return {"branch": name.removeprefix("refs/heads/"), **({"commit": found} if found else {})}


def package(files: dict[str, bytes]) -> bytes:
    """A ZIP of evidence files with a manifest of their hashes and a programme that checks them; equal input gives equal bytes."""
    files = {**files, "verify.py": VERIFIER.encode()}
    manifest = {n: hashlib.sha256(b).hexdigest() for n, b in sorted(files.items())}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in [*sorted(files.items()), ("manifest.json", json.dumps(manifest, indent=1, sort_keys=True).encode())]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def verify_package(data: bytes) -> list[str]:
    """Files whose hash isn't the manifest's, or that are missing or extra."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        have = {n: hashlib.sha256(z.read(n)).hexdigest() for n in z.namelist() if n != "manifest.json"}
        want = json.loads(z.read("manifest.json"))
    return sorted(n for n in have.keys() | want.keys() if have.get(n) != want.get(n))
