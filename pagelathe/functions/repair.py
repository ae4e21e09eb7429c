"""Reading one JSON object from a model's answer, with a careful repair of what such answers get wrong.

Only an answer that begins with an object counts; text behind the object is ignored. A repair doubles backslashes that
JSON doesn't know (formulas), escapes raw line ends and tabs within strings, drops commas before a closing bracket and
closes what was left open after a complete member.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"


def unfenced(answer: str) -> str | None:
    """The answer, or what stands in its code fence; None if the fence isn't closed."""
    text = answer.strip()
    if not text.startswith(FENCE):
        return text
    head, *body = text.splitlines()
    ends = [i for i, line in enumerate(body) if line.strip() == FENCE]
    return "\n".join(body[: ends[0]]).strip() if ends and len(body) > 1 else None


def first_object(text: str) -> dict | None:
    if not text.startswith("{"):
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


#: A string's escape that stays as it is, a lone backslash, a quote, or a raw control character.
TOKEN = re.compile(r'\\["\\/]|\\u[0-9a-fA-F]{4}|\\|"|[\n\r\t]')
CONTROL = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}


def tidy_strings(text: str) -> str:
    """Within strings: lone backslashes doubled, raw controls escaped."""
    inside = False

    def fix(m: re.Match) -> str:
        nonlocal inside
        t = m[0]
        if t == '"':
            inside = not inside
            return t
        if not inside:
            return t
        return CONTROL.get(t) or ("\\\\" if t == "\\" else t)

    return TOKEN.sub(fix, text)


def closed(text: str) -> str:
    """Without commas before closing brackets, and with what is open closed."""
    out, open_, inside, skip = [], [], False, False
    for c in text:
        if inside:
            out.append(c)
            inside, skip = not (c == '"' and not skip), c == "\\" and not skip
        elif c == '"':
            inside, skip = True, False
            out.append(c)
        else:
            if c in "{[":
                open_.append("}" if c == "{" else "]")
            elif c in "}]":
                while out and out[-1] in " \n\r\t,":
                    out.pop()
                if open_:
                    open_.pop()
            out.append(c)
            if c in "}]" and not open_:
                break
    tail = '"' if inside else ""
    return "".join(out).rstrip(" \n\r\t,") + tail + "".join(reversed(open_))


def read_object(answer: str | None) -> tuple[dict | None, bool]:
    """The answer's object and whether it needed a repair; (None, False) where there is none."""
    text = unfenced(answer or "")
    if text is None:
        return None, False
    if (found := first_object(text)) is not None:
        return found, False
    if not text.startswith("{"):
        return None, False
    found = first_object(closed(tidy_strings(text)))
    return found, found is not None


def json_object(answer: Column) -> Column:
    """Struct of json (the object as canonical text, or null) and repaired."""

    @F.arrow_udf("struct<json: string, repaired: boolean>")
    def run(answers: pa.Array) -> pa.Array:
        found = [read_object(a) for a in answers.to_pylist()]
        text = [None if x is None else json.dumps(x, ensure_ascii=False) for x, _ in found]
        return pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array([r for _, r in found], pa.bool_())], names=["json", "repaired"])

    return run(answer)
