"""Chat formatting by schema fingerprint.

A record (JSON) is walked once; the sorted set of its nested field paths is hashed, and the hash selects a declarative mapping
that turns the layout (messages, prompts with answers, instructions, question pairs) into canonical (role, text) turns. Turns
are rendered with marks that can't occur inside a text, since every mark-like string of a text gets one more backslash after
its first character; reading takes one away again, so rendering is reversible. The loss mask covers assistant texts.

Defined results: null or absent text is empty; a null or empty record, JSON that can't be read and a layout without mapping
give no turns, an empty formatted text and a null mapping name (the row stays); equal rows stay equal rows; rows of one
conversation with the same turn number are ordered by role, then text; a null key is a key like any other. A formatted
conversation is one value, so a single conversation must fit into one row (2 GB).
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import arrow_map

TURN, ROLE, END = "<s>", "[/ROLE]", "</s>"
#: what a text may not hold unescaped: sentence marks, and instruction and role marks
MARK = r"([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\])"
MARKED = r"([<\[])\\(\\*)(/?s>|/?INST\]|/?ROLE\])"
_MARK, _MARKED = re.compile(MARK), re.compile(MARKED)

#: Declarative mappings: the field paths that make the layout, paths that may be missing, and the steps that emit turns.
MAPPINGS = [
    {"name": "messages", "paths": ["messages[].role", "messages[].content"], "steps": [{"each": "messages", "role": "role", "text": "content"}]},
    {"name": "no_messages", "paths": ["messages[none]"], "steps": []},
    {"name": "shared_chats", "paths": ["conversations[].from", "conversations[].value"], "optional": ["id", "system"],
     "steps": [{"role": "system", "texts": ["system"], "if_present": True}, {"each": "conversations", "role": "from", "text": "value"}]},
    {"name": "instruction", "paths": ["instruction", "output"], "optional": ["input", "system"],
     "steps": [{"role": "system", "texts": ["system"], "if_present": True}, {"role": "user", "texts": ["instruction", "input"]}, {"role": "assistant", "texts": ["output"]}]},
    {"name": "instruction_history", "paths": ["instruction", "output", "history[][]"], "optional": ["input", "system"],
     "steps": [{"role": "system", "texts": ["system"], "if_present": True}, {"pairs": "history", "roles": ["user", "assistant"]},
               {"role": "user", "texts": ["instruction", "input"]}, {"role": "assistant", "texts": ["output"]}]},
    {"name": "prompt_completion", "paths": ["prompt", "completion"], "optional": ["system"],
     "steps": [{"role": "system", "texts": ["system"], "if_present": True}, {"role": "user", "texts": ["prompt"]}, {"role": "assistant", "texts": ["completion"]}]},
    {"name": "prompt_response", "paths": ["prompt", "response"], "optional": ["system"],
     "steps": [{"role": "system", "texts": ["system"], "if_present": True}, {"role": "user", "texts": ["prompt"]}, {"role": "assistant", "texts": ["response"]}]},
    {"name": "question_answer", "paths": ["question", "answer"], "optional": ["context", "id"],
     "steps": [{"role": "user", "texts": ["context", "question"]}, {"role": "assistant", "texts": ["answer"]}]},
    {"name": "nested_dialogue", "paths": ["data.dialogue[].speaker", "data.dialogue[].utterance"], "steps": [{"each": "data.dialogue", "role": "speaker", "text": "utterance"}]},
]
#: role names of the layouts and their canonical names
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
SCHEMA = "fingerprint string, mapping string, n_turns long, formatted string, loss_spans array<struct<start:long,length:long>>"


def field_paths(value: object, path: str = "") -> set[str]:
    """Nested field paths; elements of a list share the path ``[]``, a list without elements has the path ``[none]``."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{path}.{k}" if path else k) for k, v in value.items()))
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{path}[]") for v in value)) if value else {f"{path}[none]"}
    return {path}


def fingerprint(paths: set[str] | list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:32]


def mapping_table(mappings: list[dict] = MAPPINGS) -> dict[str, dict]:
    """Every fingerprint that a mapping answers to: its paths with each choice of the optional ones."""
    found: dict[str, dict] = {}
    for m in mappings:
        extra = m.get("optional", [])
        for n in range(len(extra) + 1):
            for chosen in itertools.combinations(extra, n):
                found.setdefault(fingerprint([*m["paths"], *chosen]), m)
    return found


def _text(value: object) -> str:
    if value is None:
        return ""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _at(record: dict, path: str) -> object:
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record


def turns_of(record: dict, mapping: dict, roles: dict[str, str] = ROLES) -> list[tuple[str, str]]:
    turns: list[tuple[str, str]] = []
    for step in mapping["steps"]:
        if "each" in step:
            for item in _at(record, step["each"]) or []:
                role = _text(item.get(step["role"]))
                turns.append((roles.get(role, role), _text(item.get(step["text"]))))
        elif "pairs" in step:
            for pair in _at(record, step["pairs"]) or []:
                turns += [(role, _text(text)) for role, text in zip(step["roles"], pair, strict=False)]
        else:
            texts = [t for t in (_text(_at(record, p)) for p in step["texts"]) if t]
            if texts or not step.get("if_present"):
                turns.append((step["role"], "\n\n".join(texts)))
    return turns


def escape(text: str) -> str:
    return _MARK.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _MARKED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[dict]]:
    """The formatted text, and the code-point spans of the texts under the loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{ROLE}", escape(text)
        if role == learn:
            spans.append({"start": at + len(head), "length": len(body)})
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part[len(TURN):].partition(ROLE)
        turns.append((unescape(role), unescape(text)))
    return turns


def format_chats(df: DataFrame, key: str, record: str, mappings: list[dict] = MAPPINGS, roles: dict[str, str] = ROLES) -> DataFrame:
    """One row per record: key, fingerprint, mapping name, number of turns, formatted text and loss spans."""
    known = mapping_table(mappings)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("fingerprint", "mapping", "n_turns", "formatted", "loss_spans")}
        for raw in batch.column(1).to_pylist():
            mark, mapping, turns = None, None, []
            try:
                value = json.loads(raw) if raw else None
                mark = fingerprint(field_paths(value)) if isinstance(value, dict) else None
                mapping = known.get(mark)
                turns = turns_of(value, mapping, roles) if mapping else []
            except (ValueError, RecursionError):  # no JSON, or nested too deeply to be read
                mark, mapping = None, None
            text, spans = render(turns)
            for c, v in zip(out, (mark, mapping and mapping["name"], len(turns), text, spans), strict=True):
                out[c].append(v)
        return out | {key: batch.column(0)}

    slim = df.select(key, record)
    return arrow_map(slim, run, f"`{key}` {slim.schema[key].dataType.simpleString()}, {SCHEMA}")


def records_of_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as one record per conversation, in the layout of message lists."""
    empty = F.lit("")
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("content"))
    messages = F.transform(F.array_sort(F.collect_list(row)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return df.groupBy(key).agg(F.to_json(F.struct(messages.alias("messages"))).alias("record"))


def digests(formatted: DataFrame, key: str) -> DataFrame:
    """Digests of what a formatted text says, read from the text and its loss spans alone."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {c: [] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = read_back(text)
            learnt = "".join(unescape(text[s["start"]:s["start"] + s["length"]]) for s in spans)
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            for c, v in zip(out, (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)), strict=True):
                out[c].append(v)
        return out | {key: batch.column(0)}

    slim = formatted.select(key, "formatted", "loss_spans")
    return arrow_map(slim, run, f"`{key}` {slim.schema[key].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
