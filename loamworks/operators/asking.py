"""Stages that ask a provider (a language model or anything that answers texts): extraction, judging, rewriting.

A provider is a function that takes a role and a list of objects and returns a text of JSON; it goes to the tasks, so it has to be
picklable. Rows of a run are asked about in batches of their order, and answers go back by their index, so that neither the number of
tasks nor the order in which batches are done shows in a result. If a batch of a run fails, be it asked or read, the run has no result
but the failure of its first failing batch. Batches are keyed by run and number: a run of any length is spread over tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markers as M

BATCH = 20
LEAST = 0.6
LONGEST = 400
Provider = Callable[[str, list[dict]], str]

#: What an extracted item has, and of which kind; the first five it must have.
ITEM = {"title": str, "body": str, "kind": str, "confidence": float, "is_noise": bool, "evidence_quote": str, "rationale": str, "durability_score": float, "reusability_score": float, "specificity_score": float, "source_trust_score": float}
REQUIRED = 5
#: Judgments are asked for twice more where the first one is between these; beyond the last two the item goes.
NOISE, GROUNDED = (0.35, 0.65), (0.45, 0.7)
MOST_NOISE, LEAST_GROUNDED = 0.7, 0.5
SCORES = ("confidence", "durability", "reusability", "specificity", "evidence_grounded", "noise_risk")


# -- reading answers


def salvage(text: str) -> list:
    """The array in an answer: all of it, or what stands from the first opening to the last closing bracket."""
    text = (text or "").strip()
    if not text:
        raise ValueError("the answer is empty")
    try:
        found = json.loads(text)
        if isinstance(found, list):
            return found
    except ValueError:
        pass
    start, end = text.find("["), text.rfind("]")
    if start < 0 or end < start:
        raise ValueError("the answer has no whole array")
    found = json.loads(text[start : end + 1])
    return found


def _value(x: object, kind: type) -> object:
    if kind is float and isinstance(x, (int, float)) and not isinstance(x, bool):
        return float(x)
    return x if isinstance(x, kind) and (kind is not float) else None


def read_items(text: str) -> list[dict]:
    """Items of an extraction's answer; one that lacks a field it must have spoils the answer."""
    out = []
    for n, item in enumerate(salvage(text)):
        made = {k: _value(item.get(k), kind) for k, kind in ITEM.items()} if isinstance(item, dict) else {}
        lost = [k for k in list(ITEM)[:REQUIRED] if made.get(k) is None]
        if lost:
            raise ValueError(f"item {n} lacks {', '.join(lost)}")
        out.append(made)
    return out


# -- extraction


def in_batches(rows: DataFrame, run: str = "run", order: str = "seq", size: int = BATCH) -> DataFrame:
    """With ``nth`` (from 0, within the run) and ``batch``."""
    nth = F.row_number().over(Window.partitionBy(run).orderBy(order)) - 1
    return rows.withColumn("nth", nth).withColumn("batch", F.floor(F.col("nth") / size).cast("long"))


def extract(paragraphs: DataFrame, provider: Provider, size: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """Items of paragraphs (run, seq, text), in order: run, place and ITEM's columns; and (run, error) of the runs that failed."""
    shape = "run long, batch long, error string, items array<string>"

    def ask(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("nth")
        error, items = None, []
        try:
            items = [json.dumps(x, ensure_ascii=False) for x in read_items(provider("extract", [{"index": i, "text": t} for i, t in enumerate(pdf["text"])]))]
        except Exception as e:  # whatever a provider does wrong fails its run, and no other
            error = f"{type(e).__name__}: {e}"
        return pd.DataFrame({"run": [key[0]], "batch": [key[1]], "error": [error], "items": [items]})

    from ..sources.shared import written

    asked = written(in_batches(paragraphs.select("run", "seq", "text"), size=size).groupBy("run", "batch").applyInPandas(ask, shape))
    failed = asked.filter("error IS NOT NULL").groupBy("run").agg(F.min_by("error", "batch").alias("error"))
    kept = asked.join(failed, "run", "left_anti").select("run", "batch", F.posexplode("items").alias("at", "item"))
    kinds = {str: "string", float: "double", bool: "boolean"}
    item = F.from_json("item", ", ".join(f"{k} {kinds[v]}" for k, v in ITEM.items()))
    place = F.row_number().over(Window.partitionBy("run").orderBy("batch", "at"))
    return kept.withColumn("place", place).select("run", "place", item.alias("i")).select("run", "place", "i.*"), failed


def usable(items: DataFrame, least: float = LEAST) -> DataFrame:
    """No noise, sure enough, with title and body, and not too long."""
    return items.filter(~F.col("is_noise") & (F.col("confidence") >= least) & (F.trim("title") != "") & (F.trim("body") != "") & (F.octet_length("body") <= LONGEST))


# -- judging


def ambiguous(judgment: dict) -> bool:
    noise, grounded = judgment.get("noise_risk"), judgment.get("evidence_grounded")
    return (noise is not None and NOISE[0] <= noise <= NOISE[1]) or (grounded is not None and GROUNDED[0] <= grounded <= GROUNDED[1])


def combined(judgments: list[dict]) -> dict:
    """The vote of some judgments: a tie keeps; reasons follow each other, scores are means of those that are given."""
    keeps = sum(j["decision"] == "keep" for j in judgments)
    given = {s: [j[s] for j in judgments if j.get(s) is not None] for s in SCORES}
    out = {"decision": "keep" if keeps * 2 >= len(judgments) else "reject", "reason": "; ".join(j["reason"] for j in judgments if j["reason"].strip())}
    return out | {s: sum(v) / len(v) if v else None for s, v in given.items()}


def read_judgment(text: str) -> dict:
    found = json.loads((text or "").strip())
    if found.get("decision") not in ("keep", "reject"):
        raise ValueError("a judgment decides to keep or to reject")
    return {"decision": found["decision"], "reason": _value(found.get("reason"), str) or ""} | {s: _value(found.get(s), float) for s in SCORES}


def verdict(judgment: dict, tier: str) -> bool:
    """Whether an item stays: it is kept, not too noisy, and well grounded unless it is a rule of its project."""
    grounded, noise = judgment["evidence_grounded"], judgment["noise_risk"]
    weak = tier != "project_rule" and (1.0 if grounded is None else grounded) < LEAST_GROUNDED
    return judgment["decision"] == "keep" and not weak and (noise or 0.0) <= MOST_NOISE


def judge(items: DataFrame, provider: Provider) -> DataFrame:
    """Items (run, place, body, evidence, memory_tier, ...) with ``votes``, ``judged`` (whether they stay) and ``verdict_reason``. An
    ambiguous judgment is put to two more votes; where judging fails the item stays without one."""
    shape = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in items.schema.fields)}, votes int, judged boolean, verdict_reason string"

    def ask(frames):
        for pdf in frames:
            out = []
            for body, evidence, tier in zip(pdf["body"], pdf["evidence"], pdf["memory_tier"]):
                one = lambda vote, body=body, evidence=evidence: read_judgment(provider("judge", [{"body": body, "evidence": evidence, "vote": vote}]))
                try:
                    votes = [one(0)]
                    if ambiguous(votes[0]):
                        votes += [one(1), one(2)]
                    made = combined(votes) if len(votes) > 1 else votes[0]
                    out.append((len(votes), verdict(made, tier), made["reason"]))
                except Exception as e:
                    out.append((0, True, f"{type(e).__name__}: {e}"))
            yield pdf.assign(votes=pd.Series([o[0] for o in out], dtype="int32"), judged=[o[1] for o in out], verdict_reason=[o[2] for o in out])

    return items.mapInPandas(ask, shape)


# -- rewriting


def patched(candidate: dict, patch: dict | None, valid: Callable[[str], bool], titled: Callable[[str], str]) -> dict | None:
    """A candidate after its patch: without one it stays as it is, a rejection drops it."""
    if patch is None:
        return candidate
    if patch.get("decision") == "reject":
        return None
    new = dict(candidate)
    body = (patch.get("body") or "").strip()
    if body and valid(body):
        new["body"] = body
    new["title"] = patch.get("title") if (patch.get("title") or "").strip() else titled(new["body"])
    if patch.get("kind") in M.REFINE_KINDS:
        new["kind"] = patch["kind"]
    if patch.get("memory_tier") in M.TIERS:
        new["memory_tier"] = patch["memory_tier"]
        new["scope"] = "project" if patch["memory_tier"] == "project_rule" else "global"
    if _value(patch.get("confidence"), float) is not None:
        new["confidence"] = min(1.0, max(0.0, float(patch["confidence"])))
    new["reason"] = patch["reason"] if (patch.get("reason") or "").strip() else "Refined final candidate into condition-action agent memory."
    new["template"] = "llm-memory-refine"
    return new


def short_title(body: str) -> str:
    words = body.split()
    return " ".join(words[:6]) if len(words) >= 3 else body[:24]


def refine(candidates: DataFrame, provider: Provider, required: bool = False, size: int = BATCH) -> DataFrame:
    """Candidates (run, seq, title, body, kind, scope, memory_tier, template, confidence, reason, ...) after a rewriting by batches. An
    answer names candidates by their index in the batch; of several patches of one index the last counts. Where a batch fails, its
    candidates stay as they are, or go if a rewriting is ``required``. ``refined`` tells which were patched."""
    names = [f.name for f in candidates.schema.fields]
    shape = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in candidates.schema.fields)}, refined boolean"

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("nth")[names].to_dict("records")
        rows = [{k: None if isinstance(v, float) and v != v else v for k, v in r.items()} for r in rows]
        try:
            answer = json.loads(provider("refine", [{"index": i} | {k: r[k] for k in ("title", "body", "kind", "scope", "memory_tier")} for i, r in enumerate(rows)]).strip())
            patches = {p["index"]: p for p in answer["items"]}
            out = [(patched(r, patches.get(i), lambda b: 16 <= len(b) <= 320, short_title), i in patches) for i, r in enumerate(rows)]
        except Exception:
            out = [] if required else [(r, False) for r in rows]
        return pd.DataFrame([r | {"refined": p} for r, p in out if r is not None], columns=[*names, "refined"])

    return in_batches(candidates, size=size).groupBy("run", "batch").applyInPandas(ask, shape)


# -- a provider without a model


def rule_provider(role: str, items: list[dict]) -> str:
    """Answers by plain rules of the texts alone, the same every time: for tests, and for runs without a model."""
    if role == "extract":
        found = []
        for x in items:
            text = " ".join((x["text"] or "").split())
            first = text.split(". ")[0][:LONGEST]
            sure = min(0.95, 0.4 + len(set(text.lower().split())) / 50)
            found.append({"title": short_title(first), "body": first, "kind": "constraint" if "never" in text.lower() or "不要" in text else "preference", "confidence": sure, "is_noise": len(text) < 24, "evidence_quote": first[:80], "rationale": f"first sentence of {len(text)} signs"})
        return "Here is what I found: " + json.dumps(found, ensure_ascii=False)
    if role == "judge":
        body = items[0]["body"]
        letters = sum(c.isalpha() for c in body) / max(1, len(body))
        noise = round(1 - letters, 3)
        return json.dumps({"decision": "reject" if noise > 0.3 + 0.05 * items[0]["vote"] else "keep", "reason": f"noise {noise}", "noise_risk": noise * 2, "evidence_grounded": 1.0 if body[:20] in (items[0]["evidence"] or "") else 0.4})
    patches = [{"index": x["index"], "decision": "reject" if len(x["body"]) < 20 else "keep", "title": None, "body": f"When it comes up: {x['body']}" if x["index"] % 2 == 0 else None, "kind": None, "memory_tier": None, "confidence": None, "reason": ""} for x in items if x["index"] % 3 != 2]
    return json.dumps({"items": patches}, ensure_ascii=False)
