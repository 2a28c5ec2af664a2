"""Prompt lineage: fingerprints, source scans, matching of sites, rollups, recordings."""

from __future__ import annotations

import ast
import hashlib
import unicodedata
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graphs import components

#: Severity of verdicts, for the rollup of a case's targets.
SEVERITY = {"unchanged": 0, "unknown": 1, "changed": 2}
ANCHOR = ["file_path", "qualname", "sdk", "call_site", "role", "role_position"]
SITE = "file_path string, line int, sdk string, call_site string, role string, role_position int, qualname string, fingerprint string, loose_fingerprint string, is_dynamic boolean"
IGNORED = (".git", "__pycache__", "node_modules", ".venv", "venv", "build", "dist", ".tox", "site-packages")


def normalised(text: str) -> str:
    """NFC, no trailing white space on lines or around the text."""
    return "\n".join(line.rstrip() for line in unicodedata.normalize("NFC", text).splitlines()).strip()


def loosely(text: str) -> str:
    return " ".join(unicodedata.normalize("NFC", text).split())


def fingerprints(text: Column) -> Column:
    """struct<fingerprint, loose_fingerprint> of a text; null for null."""

    @F.pandas_udf("struct<fingerprint:string,loose_fingerprint:string>")
    def run(c: pd.Series) -> pd.DataFrame:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return pd.DataFrame([(sha(normalised(t)), sha(loosely(t))) if t is not None else (None, None) for t in c], columns=["fingerprint", "loose_fingerprint"])

    return run(text)


def _literal(node: ast.AST, names: dict[str, str]) -> str | None:
    """The text of a constant, a constant format string, a sum of these or a module constant."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    if isinstance(node, ast.JoinedStr):
        parts = [_literal(v, names) for v in node.values]
        return "".join(parts) if None not in parts else None
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        a, b = _literal(node.left, names), _literal(node.right, names)
        return a + b if a is not None and b is not None else None
    return names.get(node.id) if isinstance(node, ast.Name) else None


def sites_in(source: str, path: str) -> list[tuple]:
    """Prompt sites of one file: keyword messages, system and prompt of calls whose name ends like a completion call."""
    tree = ast.parse(source)
    assigned: dict[str, list[str | None]] = {}
    for node in ast.walk(tree):
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, (ast.AnnAssign, ast.AugAssign)) else []
        for t in targets:
            if isinstance(t, ast.Name):
                value = node.value if not isinstance(node, ast.AugAssign) and node in tree.body else None
                assigned.setdefault(t.id, []).append(_literal(value, {}) if value is not None else None)
    names = {k: v[0] for k, v in assigned.items() if len(v) == 1 and v[0] is not None}
    found: list[tuple] = []

    def add(call: ast.Call, where: str, sdk: str, role: str, place: int, node: ast.AST) -> None:
        said = _literal(node, names)
        sha = (lambda s: hashlib.sha256(s.encode()).hexdigest()) if said is not None else (lambda s: "")
        found.append((path, call.lineno, sdk, ast.unparse(call.func), role, place, where, sha(normalised(said or "")), sha(loosely(said or "")), said is None))

    def visit(node: ast.AST, where: str) -> None:
        for child in ast.iter_child_nodes(node):
            inside = f"{where}.{child.name}".lstrip(".") if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else where
            if isinstance(child, ast.Call):
                name = ast.unparse(child.func)
                sdk = next((s for s, tail in (("openai", "chat.completions.create"), ("anthropic", "messages.create"), ("litellm", "completion")) if name == tail or name.endswith(f".{tail}")), None)
                for k in child.keywords if sdk else ():
                    if k.arg in ("system", "prompt"):
                        add(child, where, sdk, k.arg, 0, k.value)
                    elif k.arg == "messages" and isinstance(k.value, ast.List):
                        for i, m in enumerate(k.value.elts):
                            fields = {_literal(a, {}): b for a, b in zip(m.keys, m.values, strict=True) if a is not None} if isinstance(m, ast.Dict) else {}
                            if "content" in fields:
                                add(child, where, sdk, _literal(fields.get("role", ast.Constant("")), {}) or "", i, fields["content"])
                    elif k.arg == "messages":
                        add(child, where, sdk, "messages", 0, k.value)
            visit(child, inside)

    visit(tree, "")
    return found


def scan_sources(spark: SparkSession, root: str, include_tests: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sites, skipped files with reasons) of all Python files under a folder; files are read, never run."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root).select("path", "content")
    rel = F.regexp_replace("path", rf"^.*?{root.rstrip('/').rsplit('/', 1)[-1]}/", "")
    ignored = F.exists(F.split(rel, "/"), lambda p: p.isin(*IGNORED))
    files = raw.withColumn("path", rel).where(~ignored)
    if not include_tests:
        files = files.where(~F.col("path").rlike(r"(^|/)(tests?/|test_[^/]*\.py$)"))
    names = [x.split()[0] for x in SITE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[Any] = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(*s, None) for s in sites_in(bytes(content).decode(), path)]
                except (SyntaxError, ValueError) as e:
                    rows.append((path, 0, None, None, None, 0, None, None, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=[*names, "reason"])

    out = files.mapInPandas(run, f"{SITE}, reason string")
    return out.where("reason is null").drop("reason"), out.where("reason is not null").select("file_path", "reason")


def match(base: DataFrame, live: DataFrame, unscannable: DataFrame | None = None) -> DataFrame:
    """Verdict of every baseline site against the live ones: status, label, confidence, live_id.

    Sites carry id (their order). Three passes settle in turn, each on what those before
    left: dynamic sites by anchor; equal fingerprint at the same anchor; equal
    fingerprint anywhere. Within a pass a key's sites are assigned in baseline
    order, nearest line first where several fit, one live site for one baseline site;
    groups of one key are small, as a key is one prompt text or one place in the code.
    The sites that are left are settled one after the other (see ``_rescued``).
    """
    anchor = F.to_json(F.struct(*ANCHOR))
    bare = F.to_json(F.struct(*[c for c in ANCHOR if c != "file_path"]))
    b = base.withColumns({"anchor": anchor, "bare": bare})
    v = live.withColumns({"anchor": anchor, "bare": bare})
    empty = base.sparkSession.createDataFrame([], "id long, live_id long, n int")
    taken, settled = empty, None

    def tier(left: DataFrame, key: list[str], static: bool | None, status: str, label: Column, confidence: Column, nearest: bool) -> DataFrame:
        nonlocal taken, settled
        from ..storage import cut

        open_live = v.join(taken.select(F.col("live_id").alias("id")), "id", "left_anti")
        if static is not None:
            open_live = open_live.where(F.col("is_dynamic") == (not static))
        x = left.select(*key, F.col("id").alias("b_id"), F.col("line").alias("b_line"), F.col("file_path").alias("b_file"), F.col("loose_fingerprint").alias("b_loose"))
        y = open_live.select(*key, F.col("id").alias("l_id"), F.col("line").alias("l_line"), F.col("file_path").alias("l_file"), F.col("loose_fingerprint").alias("l_loose"))
        g = x.join(y, key).groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("b_id", "b_line", "b_file", "b_loose"))).alias("bs"), F.array_sort(F.collect_set(F.struct("l_id", "l_line", "l_file", "l_loose"))).alias("ls"))
        # Fold over the key's baseline sites: each takes its best open live site.
        fits = lambda acc, s: F.size(acc["open"]) > 0
        best = lambda acc, s: _best(acc["open"], s, nearest)
        pick = lambda acc, s: F.struct(
            F.concat(acc["done"], F.when(fits(acc, s), F.array(F.struct(s["b_id"].alias("id"), best(acc, s)["l_id"].alias("live_id"), F.size(acc["open"]).alias("n"), (s["b_loose"] == best(acc, s)["l_loose"]).alias("loose")))).otherwise(F.array().cast("array<struct<id:bigint,live_id:bigint,n:int,loose:boolean>>"))).alias("done"),
            F.filter(acc["open"], lambda o: ~fits(acc, s) | (o["l_id"] != F.coalesce(best(acc, s)["l_id"], F.lit(-1)))).alias("open"),
        )
        start = F.struct(F.array().cast("array<struct<id:bigint,live_id:bigint,n:int,loose:boolean>>").alias("done"), F.col("ls").alias("open"))
        got = cut(g.select(F.inline(F.aggregate("bs", start, pick)["done"])))
        out = got.select("id", "live_id", F.lit(status).alias("status"), label.alias("label"), confidence.alias("confidence"))
        settled = out if settled is None else settled.unionByName(out)
        taken = taken.unionByName(got.select("id", "live_id", "n"))
        return left.join(got.select("id"), "id", "left_anti")

    none = F.lit("")
    unsure = F.when(F.col("n") > 1, "ambiguous")
    dynamic = tier(b.where("is_dynamic"), ["anchor"], None, "unknown", F.lit("dynamic"), F.lit("structural"), False)
    left = tier(b.where("not is_dynamic"), ["fingerprint", "anchor"], True, "unchanged", none, F.lit("exact"), False)
    left = tier(left, ["fingerprint"], True, "unchanged", F.lit("moved"), F.coalesce(unsure, F.lit("moved")), True)
    from ..storage import cut

    rescued = cut(_rescued(left, v.join(taken.select(F.col("live_id").alias("id")), "id", "left_anti")))
    settled = settled.unionByName(rescued)
    left = left.join(rescued.select("id"), "id", "left_anti")
    gone = left.select("id", "file_path", none.alias("label")).unionByName(dynamic.select("id", "file_path", F.lit("dynamic").alias("label")))
    if unscannable is not None:
        gone = gone.join(unscannable.select("file_path", F.lit(True).alias("_u")).dropDuplicates(["file_path"]), "file_path", "left")
    else:
        gone = gone.withColumn("_u", F.lit(None).cast("boolean"))
    lost = gone.select("id", F.lit(None).cast("long").alias("live_id"), F.when(F.col("_u"), "unknown").otherwise("removed").alias("status"), F.when(F.col("_u"), F.concat_ws(",", F.nullif("label", F.lit("")), F.lit("unscannable"))).otherwise(F.col("label")).alias("label"), F.lit("structural").alias("confidence"))
    return settled.unionByName(lost)


_RESCUED = "id long, live_id long, status string, label string, confidence string"


def _rescued(left: DataFrame, live: DataFrame) -> DataFrame:
    """Verdicts of baseline sites whose text is gone, each in its turn: a site takes the nearest static live site at its own place (changed), else a
    dynamic one there (became dynamic), else the only one that lies elsewhere in another file under the same name with the same loose text (renamed).

    What a site takes no later site can have. Sites can compete only if they share a place, or a name and a loose text: these
    are the edges of a graph, and each of its components is settled by one fold in baseline order.
    """
    place = F.xxhash64(F.lit(0), "anchor")
    moved = F.when(~F.col("is_dynamic") & (F.coalesce("loose_fingerprint", F.lit("")) != ""), F.xxhash64(F.lit(1), "bare", "loose_fingerprint"))
    fields = ["id", "line", "file_path", "anchor", "bare", "loose_fingerprint", "is_dynamic"]
    b, v = (x.select(*fields, place.alias("_a"), moved.alias("_m")) for x in (left, live))
    # A key that only one side has makes nobody compete.
    keys = lambda x: x.select(F.col("_a").alias("k")).union(x.where("_m is not null").select("_m")).distinct()
    shared = keys(b).join(keys(v), "k", "left_semi")
    known = lambda x, c: x.join(shared.select(F.col("k").alias(c), F.lit(True).alias(f"{c}_in")), c, "left")
    b, v = (known(known(x, "_a"), "_m").where("_a_in or _m_in") for x in (b, v))
    ends = lambda x: x.select(F.when(F.col("_a_in"), F.col("_a")).otherwise(F.col("_m")).alias("a"), F.when(F.col("_m_in"), F.col("_m")).otherwise(F.col("_a")).alias("b"))
    part = components(ends(b).union(ends(v)))
    node = F.when(F.col("_a_in"), F.col("_a")).otherwise(F.col("_m")).alias("node")
    both = b.select(node, F.lit(False).alias("live"), *fields).union(v.select(node, F.lit(True), *fields))
    return both.join(part, "node").select("component", "live", *fields).groupBy("component").applyInPandas(_in_turn, _RESCUED)


def _in_turn(rows_: pd.DataFrame) -> pd.DataFrame:
    """The fold over one component."""
    live, sites = rows_[rows_["live"]], rows_[~rows_["live"]]
    places: dict[str, list[Any]] = {}
    texts: dict[tuple[str, str], list[Any]] = {}
    for o in live.sort_values("id").itertuples():
        places.setdefault(o.anchor, []).append(o)
        if not o.is_dynamic and o.loose_fingerprint:
            texts.setdefault((o.bare, o.loose_fingerprint), []).append(o)
    gone: set[int] = set()
    rows = []
    for s in sites.sort_values("id").itertuples():
        here = [o for o in places.get(s.anchor, ()) if o.id not in gone]
        fixed = [o for o in here if not o.is_dynamic]
        away = [o for o in texts.get((s.bare, s.loose_fingerprint), ()) if o.id not in gone and o.file_path != s.file_path] if s.loose_fingerprint else []
        if fixed:
            best = min(fixed, key=lambda o: (abs(o.line - s.line), o.id))
            same = bool(s.loose_fingerprint) and best.loose_fingerprint == s.loose_fingerprint
            rows.append((s.id, best.id, "changed", "formatting-only" if same else "", "ambiguous" if len(fixed) > 1 else "structural"))
        elif here:
            rows.append((s.id, here[0].id, "unknown", "became-dynamic", "structural"))
        elif len(away) == 1:
            rows.append((s.id, away[0].id, "changed", "file-renamed,formatting-only", "structural"))
        else:
            continue
        gone.add(rows[-1][1])
    return pd.DataFrame(rows, columns=["id", "live_id", "status", "label", "confidence"])


TARGET = "struct<source:string,file_path:string,line:int,sdk:string,call_site:string,role:string,role_position:int,qualname:string,is_dynamic:boolean,fingerprint:string,loose_fingerprint:string>"


def target_verdicts(targets: DataFrame, live: DataFrame, unscannable: DataFrame | None = None) -> DataFrame:
    """status, label of every target (rows with target_id and the fields of TARGET) against live sites: each by itself, so nothing is used up.

    Targets from outside and observed at run time can't be verified, dynamic ones stay unknown; the others
    go through the same tiers as sites, as joins with what live sites have at each key.
    """
    anchor, bare = F.to_json(F.struct(*ANCHOR)), F.to_json(F.struct(*[c for c in ANCHOR if c != "file_path"]))
    t = targets.withColumns({"anchor": anchor, "bare": bare}).withColumn("loose_fingerprint", F.coalesce("loose_fingerprint", F.lit("")))
    v = live.withColumns({"anchor": anchor, "bare": bare})
    fixed = v.where("not is_dynamic")
    here = t.select("target_id", "anchor", "line", "loose_fingerprint").join(fixed.select("anchor", F.col("line").alias("l"), F.col("id").alias("i"), F.col("loose_fingerprint").alias("x")), "anchor")
    nearest = here.groupBy("target_id").agg(F.min_by(F.coalesce((F.col("x") == F.col("loose_fingerprint")) & (F.col("x") != ""), F.lit(False)), F.struct(F.abs(F.col("l") - F.col("line")), "i")).alias("same"))
    away = t.where("loose_fingerprint != ''").select("target_id", "bare", "loose_fingerprint", "file_path").join(fixed.select("bare", "loose_fingerprint", F.col("file_path").alias("f")), ["bare", "loose_fingerprint"]).where("f != file_path").groupBy("target_id").agg(F.count("*").alias("away"))
    there = lambda rows, keys, name: rows.select(*keys, F.lit(True).alias(name)).distinct()
    x = (
        t.join(there(fixed, ["fingerprint", "anchor"], "exact"), ["fingerprint", "anchor"], "left").join(there(fixed, ["fingerprint"], "moved"), "fingerprint", "left")
        .join(there(v.where("is_dynamic"), ["anchor"], "became"), "anchor", "left").join(nearest, "target_id", "left").join(away, "target_id", "left")
    )
    x = x.join(unscannable.select("file_path", F.lit(True).alias("unseen")).distinct(), "file_path", "left") if unscannable is not None else x.withColumn("unseen", F.lit(None).cast("boolean"))
    found = (
        F.when(F.col("source") == "external", F.struct(F.lit("unverifiable").alias("status"), F.lit("").alias("label"))).when(F.col("source") == "runtime", _said("unverifiable", "runtime")).when(F.col("is_dynamic"), _said("unknown", "dynamic"))
        .when(F.col("exact"), _said("unchanged", "")).when(F.col("moved"), _said("unchanged", "moved")).when(F.col("same"), _said("changed", "formatting-only")).when(F.col("same").isNotNull(), _said("changed", ""))
        .when(F.col("became"), _said("unknown", "became-dynamic")).when(F.col("away") == 1, _said("changed", "file-renamed,formatting-only")).when(F.col("unseen"), _said("unknown", "unscannable")).otherwise(_said("removed", ""))
    )
    return x.select("target_id", found.alias("v")).select("target_id", "v.*")


def _said(status: str, label: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(label).alias("label"))


#: Case files that are known by their name.
CASE_FILE = "seed_cases.jsonl"


def case_lines(spark: SparkSession, root: str) -> DataFrame:
    """file_path, index (among the file's lines that aren't blank), value, reason of all case files under a folder.

    A case file is one named like a bootstrap's, or a .jsonl whose lines that are JSON objects have an input, more than
    half of them. Folders with a dot and the scanner's ignored ones aren't looked into. A broken line has a reason and no case.
    """
    from .ranks import numbered

    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    rel = F.regexp_replace(F.url_decode("_metadata.file_path"), rf"^.*?{root.rstrip('/').rsplit('/', 1)[-1]}/", "")
    lines = raw.select(rel.alias("file_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_i"), "value").where(F.trim("value") != "")
    folders = F.slice(F.split("file_path", "/"), 1, F.size(F.split("file_path", "/")) - 1)
    lines = lines.where(~F.exists(folders, lambda p: p.isin(*IGNORED) | p.startswith(".")))
    parsed = F.try_parse_json("value")
    reason = F.when(parsed.isNull(), "no JSON").when(F.schema_of_variant(parsed).startswith("OBJECT"), None).otherwise("no object")
    asks = F.get_json_object("value", "$.input").isNotNull()
    placed = numbered(lines.withColumns({"reason": reason, "_asks": asks}), "file_path", "_block", "_i", name="_no")
    files = placed.groupBy("file_path").agg(F.min("_no").alias("_first"), F.count_if(F.col("reason").isNull()).alias("_n"), F.count_if(F.col("reason").isNull() & F.col("_asks")).alias("_asked"))
    files = files.where(F.element_at(F.split("file_path", "/"), -1).eqNullSafe(CASE_FILE) | (F.col("_asked") * 2 > F.col("_n")))
    return placed.join(files, "file_path").select("file_path", (F.col("_no") - F.col("_first")).alias("index"), "value", "reason")


def case_verdicts(lines: DataFrame, live: DataFrame, unscannable: DataFrame | None = None, version: int = 1) -> DataFrame:
    """file_path, index, case_uid, state (unreadable, unstamped, stamped, bound) and status (the rollup of a bound case's targets) of case lines.

    A case's provenance is the object that its metadata holds under _provenance.
    """
    p = lambda k: F.get_json_object("value", f"$.metadata._provenance{k}")
    x = lines.withColumns({"case_uid": p(".case_uid"), "targets": F.from_json(p(".targets"), f"array<{TARGET}>"), "_p": p("")})
    late = F.coalesce(p(".schema_version").try_cast("int"), F.lit(1)) > version
    broken = F.col("reason").isNotNull() | (F.col("_p").isNotNull() & ~F.startswith("_p", F.lit("{"))) | (F.col("_p").isNotNull() & late)
    held = F.coalesce(F.size("targets"), F.lit(0)) > 0
    x = x.withColumn("state", F.when(broken, "unreadable").when(F.col("_p").isNull(), "unstamped").when(held, "bound").otherwise("stamped"))
    bound_ = x.where("state = 'bound'").select("file_path", "index", F.posexplode("targets").alias("n", "t"))
    t = bound_.select(F.struct("file_path", "index", "n").alias("target_id"), "t.*")
    v = target_verdicts(t.withColumn("is_dynamic", F.coalesce("is_dynamic", F.lit(False))), live, unscannable)
    rolled = rollup(v.select(F.struct("target_id.file_path", "target_id.index").alias("case_id"), "status")).select("case_id.*", "status")
    return x.join(rolled, ["file_path", "index"], "left").select("file_path", "index", "case_uid", "state", "status")


def _best(open_: Column, s: Column, nearest: bool) -> Column:
    """First candidate by file, line distance and order, or by order alone."""
    rank = lambda o: F.struct((o["l_file"] != s["b_file"]).alias("f"), F.abs(o["l_line"] - s["b_line"]).alias("d"), o["l_id"].alias("l_id"), o["l_loose"].alias("l_loose"))
    return F.try_element_at(F.array_sort(F.transform(open_, rank)) if nearest else open_, F.lit(1))


def added(base: DataFrame, live: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Static live sites that nothing claimed and whose text and anchor are both new."""
    fresh = live.where("not is_dynamic").join(verdicts.where("live_id is not null").select(F.col("live_id").alias("id")), "id", "left_anti")
    return fresh.join(base.where("not is_dynamic").select("fingerprint").distinct(), "fingerprint", "left_anti").join(base.select(*ANCHOR).distinct(), ANCHOR, "left_anti").select(live.columns)


def rollup(targets: DataFrame, case: str = "case_id") -> DataFrame:
    """Worst status of each case's targets: all removed is removed, some removed is changed."""
    rank = F.create_map(*[x for k, v in {**SEVERITY, "removed": 2}.items() for x in (F.lit(k), F.lit(v))])
    g = targets.groupBy(case).agg(F.bool_and(F.col("status") == "removed").alias("gone"), F.max(F.coalesce(F.try_element_at(rank, F.col("status")), F.lit(0))).alias("worst"))
    return g.select(case, F.when(F.col("gone"), "removed").when(F.col("worst") == 2, "changed").when(F.col("worst") == 1, "unknown").otherwise("unchanged").alias("status"))


def coverage(sites: DataFrame, targets: DataFrame) -> DataFrame:
    """sites, covered: sites that a case binds by fingerprint or by anchor, as two equi-joins."""
    anchor = F.to_json(F.struct(*ANCHOR))
    s = sites.withColumn("anchor", anchor)
    by = s.join(targets.select("fingerprint").distinct(), "fingerprint", "left_semi").select("id").union(s.join(targets.select("anchor").distinct(), "anchor", "left_semi").select("id")).distinct()
    return s.select("id").join(by.withColumn("_c", F.lit(1)), "id", "left").agg(F.count("*").alias("sites"), F.count("_c").alias("covered"))


def merge_recordings(old: DataFrame, new: DataFrame) -> DataFrame:
    """By anchor, role and fingerprint: counts add, cases unite, first and last seen widen."""
    g = old.unionByName(new).groupBy("anchor", "role", "fingerprint")
    return g.agg(F.max("loose_fingerprint").alias("loose_fingerprint"), F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("case_uids")))).alias("case_uids"))


def runtime_records(recordings: DataFrame) -> DataFrame:
    """One record an anchor, with the set of renderings seen there."""
    return recordings.groupBy("anchor").agg(F.array_sort(F.collect_set("fingerprint")).alias("fingerprints"), F.sum("count").alias("observations"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("case_uids")))).alias("case_uids"))


def merge_runtime(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union an anchor; observations take the larger, so merging twice changes nothing."""
    g = old.unionByName(new).groupBy("anchor")
    unite = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return g.agg(unite("fingerprints"), F.max("observations").alias("observations"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), unite("case_uids"))


def observed(runtime: DataFrame, current: DataFrame) -> DataFrame:
    """Renderings of each anchor in the baseline, now, in both, and new ones."""
    now = current.groupBy("anchor").agg(F.collect_set("fingerprint").alias("now"))
    x = runtime.join(now, "anchor", "left").withColumn("now", F.coalesce("now", F.array().cast("array<string>")))
    return x.select("anchor", F.size("fingerprints").alias("baseline_renderings"), F.size(F.array_intersect("fingerprints", "now")).alias("matched"), F.size("now").alias("current_renderings"), F.size(F.array_except("now", "fingerprints")).alias("new_renderings"))


def bindings(recordings: DataFrame) -> DataFrame:
    """Proposed case-to-site bindings, one a (case, anchor, fingerprint)."""
    return recordings.select(F.explode("case_uids").alias("case_uid"), "anchor", "fingerprint", "loose_fingerprint", "count")


def bound(cases: DataFrame, proposed: DataFrame, least: int = 1) -> DataFrame:
    """Cases (case_uid, targets: array of anchor and fingerprint) with proposed bindings added that were seen at least so often; an anchor that a case has keeps its target."""
    new = proposed.where(F.col("count") >= least).groupBy("case_uid").agg(F.array_sort(F.collect_set(F.struct("anchor", "fingerprint"))).alias("_new"))
    both = cases.join(new, "case_uid", "left").withColumn("_new", F.coalesce("_new", F.array().cast("array<struct<anchor:string,fingerprint:string>>")))
    held = F.transform("targets", lambda t: t["anchor"])
    fresh = F.filter("_new", lambda t: ~F.array_contains(held, t["anchor"]))
    return both.withColumn("targets", F.concat("targets", fresh)).drop("_new")


def site_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """Sites by call_site_id: modified, added, removed or dynamic."""
    x = base.select("call_site_id", F.col("fingerprint").alias("f0"), F.col("is_dynamic").alias("d0")).join(head.select("call_site_id", F.col("fingerprint").alias("f1"), F.col("is_dynamic").alias("d1")), "call_site_id", "full_outer")
    kind = F.when(F.coalesce("d0", F.lit(False)) | F.coalesce("d1", F.lit(False)), "dynamic").when(F.col("f0").isNull(), "added").when(F.col("f1").isNull(), "removed").when(F.col("f0") != F.col("f1"), "modified")
    return x.select("call_site_id", kind.alias("change")).where("change is not null")


