"""Stores against plain loops in Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
from loamworks.plans import registry

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(table, *columns):
    return [tuple(r[c] for c in columns) for r in pq.read_table(f"{SF}/{table}.parquet", columns=list(columns)).to_pylist()]


def test_folder_hashes(spark):
    folders = defaultdict(dict)
    for doc, text in rows("documents", "doc_id", "text"):
        if doc % 13:
            folders[doc // 16][("a/" if doc % 3 == 0 else "") + f"{doc}.md"] = text or ""
    want = {f: "sha256:" + sha("".join(f"{p}\0{t}" for p, t in sorted(files.items()))) for f, files in folders.items()}
    assert {r.folder: r.hash for r in registry.queries()["folder_hashes"](spark, SF).collect()} == want


def lines(text):
    return re.sub("\r?\n\\Z", "", text).split("\n") if text else []


def test_drift_drafts(spark):
    want, outcomes = {}, Counter()
    for doc, source, text in rows("documents", "doc_id", "source", "text"):
        wanted = text or ""
        if doc % 7 == 0:
            found = None
        elif doc % 5 == 0:
            found = " "
        elif doc % 3 == 0:
            found = f"own note {doc % 10}\n{wanted}\nown end\n"
        else:
            found = wanted.split("\n")[0] + "\r\n" if doc % 11 == 0 else wanted
        if found is None or found == wanted:
            want[doc] = ("missing" if found is None else "synced", None)
            outcomes[want[doc][0]] += 1
            continue
        left, added = Counter(line.rstrip("\r") for line in lines(wanted)), []
        for line in (x.rstrip("\r") for x in lines(found)):
            if left[line]:
                left[line] -= 1
            else:
                added.append(line)
        body = "\n".join(added).strip() or found.strip()
        agent = "codex" if doc % 2 == 0 else "claude"
        made = f"artifact:{agent}:" + ("sha256:" + sha(f"/{source or ''}/{doc}.md:{body}"))[:12]
        want[doc] = ("created", made) if body else ("blank", None)
        outcomes[want[doc][0]] += 1
    assert {r.doc_id: (r.outcome, r.draft_id) for r in registry.queries()["drift_drafts"](spark, SF).collect()} == want
    assert set(outcomes) == {"missing", "synced", "created", "blank"}


def test_preference_messages(spark):
    seen, want = set(), []
    for page, html in sorted(rows("pages", "page_id", "html")):
        title = "" if page % 9 == 0 else f"USE {page % 200}" if page % 2 == 0 else f"Use {page % 150}"
        start = f"preference #{page}"
        if not title:
            want.append(f"error: {start} has an empty title")
        elif title.lower() in seen:
            want.append(f"error: {start} has duplicate title `{title}`")
        seen.add(title.lower())
        if page % 10 == 0 or not (html or "").strip():
            want.append(f"error: {start} has an empty body")
        if page % 4 == 0:
            want.append(f"error: {start} has no required markers")
        if page % 7 == 0:
            want.append(f"warning: {start} has no context markers and may match too broadly")
    got = sorted(r.message for r in registry.queries()["preference_messages"](spark, SF).collect())
    assert got == sorted(want)
    report = registry.queries()["preference_report"](spark, SF).first()
    assert (report.errors, report.warnings) == (sum(m.startswith("error") for m in want), sum(m.startswith("warning") for m in want))
