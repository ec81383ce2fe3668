"""Chat formatting: records of many layouts become canonical turns, which a template marks and escapes reversibly.

A record is a JSON object. Its schema fingerprint is a hash of its sorted nested field paths, without array positions
and fields that are null; the fingerprint selects a declarative mapping, which says where roles and texts stand. A
mapping says which fields it needs and which it allows besides; a table of the fingerprints met so far spares looking
for it again. Records that no mapping fits are reported, not guessed at.

The template writes a turn as `<|im_start|>role`, line feed, text, `<|im_end|>`, line feed. Inside roles and texts a
backslash is doubled, a control string is broken up by backslash and dot after its first character, and a line feed in
a role is written as backslash and n; so the output can be read back exactly. The loss mask covers assistant texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apitables.llm.texts import slices

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = [START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)


@dataclass(frozen=True)
class Mapping:
    """Turns of a layout, in order: (role, field) pairs, or for each element of `each` the fields of role and text.

    A layout of pairs needs its last field; other fields that are absent or null are no turns. A layout without pairs
    and list is a turn by itself, whose role and text may be absent.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = "role"
    text: str = "text"
    ignore: frozenset[str] = field(default_factory=frozenset)

    def fits(self, paths: frozenset[str]) -> bool:
        if self.each:
            at = f"{self.each}[]"
            needed, own = {self.each}, {self.each, at, f"{at}.{self.role}", f"{at}.{self.text}"}
        elif self.fields:
            needed, own = {self.fields[-1][1]}, {f for _, f in self.fields}
        else:
            needed, own = set(), {self.role, self.text}
        return needed <= paths and not (paths - own - self.ignore)

    def readable(self, record: dict) -> bool:
        """Whether the list of a fitting record is a list of objects, which paths do not tell."""
        return not self.each or isinstance(record[self.each], list) and all(isinstance(x, dict) for x in record[self.each])

    def turns(self, record: dict) -> list[tuple[str, str]]:
        if self.each:
            return [(_text(x.get(self.role)), _text(x.get(self.text))) for x in record[self.each]]
        if self.fields:
            return [(role, _text(record[f])) for role, f in self.fields if record.get(f) is not None]
        return [(_text(record.get(self.role)), _text(record.get(self.text)))]


_IDS = ("id", "conversation_id", "conv_id")


def _besides(each: str) -> frozenset[str]:
    """What a list layout may hold besides: ids of the record, ids and names of its elements."""
    return frozenset({*_IDS, f"{each}[].id", f"{each}[].name"})


#: Tried in this order for a fingerprint that was not met before. Names of roles are mapped by ROLES.
MAPPINGS = [
    Mapping("messages", each="messages", role="role", text="content", ignore=_besides("messages")),
    Mapping("conversations", each="conversations", role="from", text="value", ignore=_besides("conversations")),
    Mapping("prompt-response", fields=(("user", "prompt"), ("assistant", "response")), ignore=frozenset({"id"})),
    Mapping("prompt-completion", fields=(("user", "prompt"), ("assistant", "completion")), ignore=frozenset({"id"})),
    Mapping("instruction-output", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output")), ignore=frozenset({"id"})),
    Mapping("question-answer", fields=(("system", "system"), ("user", "question"), ("assistant", "answer")), ignore=frozenset({"id"})),
    Mapping("turn"),
]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value: `a.b` below objects, `a[]` for elements; nulls have none."""
    found: set[str] = set()
    todo = [(value, at)]
    while todo:
        value, at = todo.pop()
        if isinstance(value, dict):
            for name, x in value.items():
                if x is not None:
                    path = f"{at}.{name}" if at else name
                    found.add(path)
                    todo.append((x, path))
        elif isinstance(value, list):
            for x in value:
                if isinstance(x, (dict, list)):
                    found.add(f"{at}[]")
                    todo.append((x, f"{at}[]"))
    return found


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def escape(text: str, role: bool = False) -> str:
    text = _CONTROL.sub(lambda m: m[0][0] + "\\." + m[0][1:], text.replace("\\", "\\\\"))
    return text.replace("\n", "\\n") if role else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {".": "", "n": "\n"}.get(m[1], m[1]), text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends in it."""
    head = f"{START}{escape(role, role=True)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of formatted text."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        out.append((unescape(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return out


def canonical_turns(df: DataFrame, key: str = "id", order: str = "turn", record: str = "record", roles: dict[str, str] | None = None) -> DataFrame:
    """(id, turn, place, role, text, layout, fingerprint): the turns in each row's JSON record.

    `order` places rows of one id (a long); `place` counts the turns of a record from 0. Roles are renamed by `roles`,
    ROLES unless given. A record that is null, no JSON object, of a layout that no mapping fits, or whose list holds
    anything but objects gives one row with a null layout, null place and null role. An empty list has no turns. Repeated rows are repeated turns.
    """
    kind = df.schema[key].dataType.simpleString()
    renamed = ROLES if roles is None else roles

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Mapping | None] = {}
        for part in slices(batches, "record"):
            of, place, role, text, layout, prints = [], [], [], [], [], []
            for i, value in enumerate(part.column("record").to_pylist()):
                mark = mapping = None
                try:
                    parsed = json.loads(value) if value is not None else None
                except ValueError:
                    parsed = None
                if isinstance(parsed, dict):
                    found = frozenset(paths(parsed))
                    mark = fingerprint(found)
                    if mark not in known:
                        if len(known) > 10_000:  # data-valued keys: start over rather than grow
                            known.clear()
                        known[mark] = next((m for m in MAPPINGS if m.fits(found)), None)
                    mapping = known[mark] if known[mark] and known[mark].readable(parsed) else None
                turns = [(renamed.get(r, r), t) for r, t in mapping.turns(parsed)] if mapping else [(None, None)]
                for n, (r, t) in enumerate(turns):
                    of.append(i)
                    place.append(n if mapping else None)
                    role.append(r)
                    text.append(t)
                    layout.append(mapping.name if mapping else None)
                    prints.append(mark)
            at = pa.array(of, pa.int64())
            yield pa.record_batch({
                "id": part.column("id").take(at), "turn": part.column("turn").take(at), "place": pa.array(place, pa.int32()),
                "role": pa.array(role, pa.string()), "text": pa.array(text, pa.string()), "layout": pa.array(layout, pa.string()), "fingerprint": pa.array(prints, pa.string())})

    rows = df.select(F.col(key).alias("id"), F.col(order).cast("bigint").alias("turn"), F.col(record).alias("record"))
    return rows.mapInArrow(convert, f"id {kind}, turn bigint, place int, role string, text string, layout string, fingerprint string")


def format_turns(turns: DataFrame) -> DataFrame:
    """(id, turn, place, role, formatted, loss_start, loss_end) for each turn of `turns` (see canonical_turns).

    A conversation's formatted text is its turns' `formatted` strung together, by turn, place, role and text; spans are in
    code points from the turn's own beginning, null where nothing is learnt. Null roles and texts are empty. Rows without a
    layout are left out.
    """
    kind = turns.schema["id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            made = [(r or "", *segment(r or "", t or "")) for r, t in zip(part.column("role").to_pylist(), part.column("text").to_pylist())]
            learnt = [r == "assistant" for r, *_ in made]
            yield pa.record_batch({
                "id": part.column("id"), "turn": part.column("turn"), "place": part.column("place"), "role": pa.array([m[0] for m in made], pa.string()),
                "formatted": pa.array([m[1] for m in made], pa.string()),
                "loss_start": pa.array([m[2] if ok else None for m, ok in zip(made, learnt)], pa.int64()),
                "loss_end": pa.array([m[3] if ok else None for m, ok in zip(made, learnt)], pa.int64())})

    rows = turns.where("layout IS NOT NULL").select("id", "turn", "place", "role", "text")
    return rows.mapInArrow(write, f"id {kind}, turn bigint, place int, role string, formatted string, loss_start bigint, loss_end bigint")


def digests(formatted: DataFrame) -> DataFrame:
    """(id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output of format_turns.

    The turns of a conversation are sorted and streamed through its digests, so a conversation of any length takes the
    memory of a turn.
    """
    kind = formatted.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state, last = None, None

        def rows(done, id_type):
            types[0] = id_type
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], names=names)

        for batch in batches:
            done = []
            ids, texts = batch.column("id"), batch.column("formatted").to_pylist()
            last = ids.type
            starts, ends = batch.column("loss_start").to_pylist(), batch.column("loss_end").to_pylist()
            for one, text, a, b in zip(ids.to_pylist(), texts, starts, ends):
                if state is None or state[0] != one:
                    if state:
                        done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))
                    state = [one, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content in read_back(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{content}\n".encode())
                if a is not None:
                    learnt = unescape(text[a:b])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode())
                state[5] += len(text)
            if done:
                yield rows(done, last)
        if state:
            yield rows([(state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])], last)

    order = ["turn", "place", "role", "formatted"]
    sorted_ = formatted.repartition("id").sortWithinPartitions("id", *order)
    return sorted_.mapInArrow(run, f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
