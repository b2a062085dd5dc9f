"""Summaries of sessions by a language model that is passed in.

A session's first messages become one prompt. An answer has to be JSON, and one for an
Arabic session has to be Arabic: else the model is asked again in stricter words, and
after the last try the session is left without a summary, so a later run finds it again.
Sessions are judged a batch at a time, and a batch's second tries go to the model together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions.gates import session_is_arabic
from memloom.functions.models import Judge, repaired_json
from memloom.functions.text import truncated
from memloom.operators.sessions import MOST_MESSAGES, user_ratio
from memloom.schema import FACT_CATEGORIES
from memloom.shared import first_rows

TRIES, FAILURES = 3, 3
LEAST_ARABIC = 0.25
BATCH = 32
RESULT = "session_id string, language string, tries int, summary array<string>, facts array<struct<key: string, category: string>>, importance int"

ENGLISH = "Answer in English."
ARABIC = (
    "أجب بالعربية.",
    "أجب بالعربية وحدها، ولا تكتب غيرها إلا أسماء التقنيات.",
    "هذه آخر محاولة: كل إجابة ليست بالعربية تُرفض.",
)
TASK = (
    "Summarise the conversation below as one JSON object with the fields summary (a list of short points), "
    f"facts (a list of objects with key, a whole sentence, and category, one of {', '.join(FACT_CATEGORIES)}) and importance (0 to 5). "
    "State only what was said, keep names, paths and versions as they are, and leave out figures that will soon have changed."
)
_LETTER = re.compile("[ء-ي]")


def transcripts(messages: DataFrame, most: int = MOST_MESSAGES, chars: int = 500) -> DataFrame:
    """``session_id, transcript, arabic``: the first ``most`` messages of each session that say anything, a line each, cut to ``chars`` characters."""
    said = first_rows(messages.filter(F.trim(F.coalesce("content", F.lit(""))) != ""), [F.col("session_id")], [F.col("id")], most)
    line = F.concat(F.lit("["), F.coalesce("role", F.lit("unknown")), F.lit("]: "), truncated("content", chars))
    # ``most`` lines of bounded length a session.
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"])
    told = said.groupBy("session_id").agg(F.array_join(lines, "\n").alias("transcript"))
    ratio = user_ratio(messages)
    return told.join(ratio, "session_id", "left").select("session_id", "transcript", F.coalesce(session_is_arabic(F.col("ratio")), F.lit(False)).alias("arabic"))


def prompt(transcript: str, arabic: bool, attempt: int = 0) -> str:
    order = ARABIC[min(attempt, len(ARABIC) - 1)] if arabic else ENGLISH
    return f"{order}\n{TASK}\n\n{transcript}"


def _parsed(answer: str | None) -> dict | None:
    """A usable answer: lists where lists are due, facts with a key."""
    text = repaired_json(answer)
    found = json.loads(text) if text else None
    if not isinstance(found, dict):
        return None
    points = [str(x) for x in found.get("summary") or [] if x] if isinstance(found.get("summary"), list) else []
    facts = [f for f in found.get("facts") or [] if isinstance(f, dict) and f.get("key")] if isinstance(found.get("facts"), list) else []
    level = found.get("importance")
    return {
        "summary": points,
        "facts": [{"key": str(f["key"]), "category": f["category"] if f.get("category") in FACT_CATEGORIES else "general"} for f in facts],
        "importance": max(0, min(5, int(level))) if isinstance(level, (int, float)) else 3,
    }


def _share(found: dict) -> float:
    """The share of Arabic letters in what an answer says."""
    text = " ".join([*found["summary"], *(f["key"] for f in found["facts"])])
    return len(_LETTER.findall(text)) / max(1, len(text))


def judged(ask: Judge, rows: list[tuple[str, str, bool]], tries: int = TRIES, failures: int = FAILURES) -> list[dict]:
    """Results of sessions ``(id, transcript, arabic)``; those without a usable answer are left out.

    A failed call, or an answer that is no JSON, is repeated up to ``failures`` times in all. An
    answer in the wrong language costs one of ``tries``.
    """
    out, open_ = [], [(i, 0, 0) for i in range(len(rows))]
    while open_:
        answers = ask([prompt(rows[i][1], rows[i][2], attempt) for i, attempt, _ in open_])
        later = []
        for (i, attempt, failed), answer in zip(open_, answers, strict=True):
            found = _parsed(answer)
            if found is None:
                if failed + 1 < failures:
                    later.append((i, attempt, failed + 1))
            elif rows[i][2] and _share(found) < LEAST_ARABIC:
                if attempt + 1 < tries:
                    later.append((i, attempt + 1, 0))
            else:
                out.append({"session_id": rows[i][0], "language": "ar" if rows[i][2] else "en", "tries": attempt + 1, **found})
        open_ = later
    return sorted(out, key=lambda r: r["session_id"])


def summarise(messages: DataFrame, model: Callable[[], Judge], done: DataFrame | None = None, tries: int = TRIES) -> DataFrame:
    """``session_id, language, tries, summary, facts, importance`` of all sessions that are not ``done`` and got a usable answer."""
    rows = transcripts(messages if done is None else messages.join(done.select("session_id"), "session_id", "left_anti"))
    kind = pa.schema(
        [("session_id", pa.string()), ("language", pa.string()), ("tries", pa.int32()), ("summary", pa.list_(pa.string()))]
        + [("facts", pa.list_(pa.struct([("key", pa.string()), ("category", pa.string())]))), ("importance", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = model()
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH).to_pydict()
                yield pa.RecordBatch.from_pylist(judged(ask, list(zip(part["session_id"], part["transcript"], part["arabic"])), tries), schema=kind)

    return rows.select(F.col("session_id").cast("string"), "transcript", "arabic").mapInArrow(run, RESULT)


def first_lines() -> Judge:
    """A stand-in for a model: the conversation's first and longest lines, as JSON between words, as models answer."""

    def ask(prompts: list[str]) -> list[str | None]:
        out = []
        for p in prompts:
            lines = [x.split("]: ", 1)[1] for x in p.partition("\n\n")[2].split("\n") if "]: " in x]
            longest = max(lines, key=lambda x: (len(x), x), default="")
            said = {"summary": lines[:1], "facts": [{"key": longest, "category": "fact"}], "importance": 1 + min(4, len(lines) // 4)}
            out.append(f"Here it is:\n```json\n{json.dumps(said, ensure_ascii=False)}\n```")
        return out

    return ask
