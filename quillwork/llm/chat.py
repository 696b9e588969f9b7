"""Chat formatting by a template compiler (operator 4).

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python closures that write a
conversation piece by piece, each piece with a flag that tells whether a model should learn to generate it.  The
language is closed: literals, variables, fields of messages, comparisons, `and`/`or`/`not`, `+`, a fixed list of
filters, `for`, `if`, `set` and `generation`.  No Python attribute or call is reachable from it.

Conversations stream: rows are sorted by conversation and turn within partitions and written turn by turn, so a
conversation of any length needs the memory of one turn (the whole-text output needs that of one conversation).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table
from .oracles import OP4

#: Strings that the format gives a meaning; in texts they are escaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TEMPLATE = (
    "{{ '<' + 's>' }}{% for m in messages %}"
    "{% if m.role == 'system' %}<<SYS>>{{ m.text | escape }}<</SYS>>"
    "{% elif m.role == 'user' %}[INST]{{ m.text | escape }}[/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}<|turn|>{{ m.role | escape }}<|text|>{{ m.text | escape }}<|end|>{% endif %}"
    "{% endfor %}"
)
_CONTROL = re.compile(r"(\\)|" + "|".join(f"({re.escape(c[0])})(?={re.escape(c[1:])})" for c in sorted(CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of every control string."""
    return _CONTROL.sub(lambda m: "\\\\" if m[1] else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_TOKENS = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[-+|().\[\]=]))")


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent: or, and, not, comparison, sum, filters, atoms.  Nodes are tuples headed by their kind."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKENS.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            kind = m.lastindex
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] > 2 else None

    def take(self, *options: str) -> str | None:
        if (found := self.peek()) in options:
            self.at += 1
            return found
        return None

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.summed()
        while op := self.take("==", "!=", "in"):
            node = (op, node, self.summed())
        return node

    def summed(self) -> tuple:
        node = self.filtered()
        while self.take("+"):
            node = ("+", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while True:
            if self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                node = ("filter", node, name)
            elif self.take("."):
                node = ("field", node, ("const", self.name()))
            elif self.take("["):
                node = ("field", node, self.either())
                self.need("]")
            else:
                return node

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if kind == 2:
            return ("const", int(text))
        if kind == 3:
            return ("const", {"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else ("name", text)
        if text == "(":
            node = self.either()
            self.need(")")
            return node
        raise TemplateError(f"unexpected {text!r}")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == 3:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text!r} is missing")


def parse(source: str) -> tuple:
    """The syntax tree of a template: ("block", nodes)."""
    parts, at = [], 0
    for m in _PARTS.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    parts.reverse()

    def block(*ends: str) -> tuple[tuple, str]:
        nodes = []
        while parts:
            kind, text = parts.pop()
            if kind == "text":
                nodes.append(("text", text))
            elif kind == "out":
                nodes.append(("out", _Expression(text).whole()))
            else:
                word = text.split(None, 1)[0] if text else ""
                if word in ends:
                    return ("block", nodes), text
                nodes.append(statement(word, text))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", nodes), ""

    def statement(word: str, text: str) -> tuple:
        if word == "for" and (m := re.fullmatch(r"for\s+(\w+)\s+in\s+(.+)", text, re.S)):
            return ("for", m[1], _Expression(m[2]).whole(), block("endfor")[0])
        if word == "set" and (m := re.fullmatch(r"set\s+(\w+)\s*=\s*(.+)", text, re.S)):
            return ("set", m[1], _Expression(m[2]).whole())
        if word == "generation" and text == word:
            return ("generation", block("endgeneration")[0])
        if word == "if":
            body, end = block("elif", "else", "endif")
            if end.startswith("elif"):
                rest = ("block", [statement("if", end[2:])])
            else:
                rest = block("endif")[0] if end.startswith("else") else ("block", [])
            return ("if", _Expression(text[2:]).whole(), body, rest)
        raise TemplateError(f"unknown tag {text!r}")

    return block()[0]


def fold(node: tuple) -> tuple:
    """The same tree with constant expressions computed, decided branches chosen and neighbouring texts joined."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind == "block":
        out: list[tuple] = []
        for x in map(fold, node[1]):
            for y in x[1] if x[0] == "block" else [x]:
                y = ("text", _shown(y[1][1])) if y[0] == "out" and y[1][0] == "const" else y
                if y[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + y[1])
                elif y != ("text", ""):
                    out.append(y)
        return ("block", out)
    if kind == "if":
        test = fold(node[1])
        if test[0] == "const":
            return fold(node[2] if test[1] else node[3])
        return ("if", test, fold(node[2]), fold(node[3]))
    made = (kind, *(fold(x) if isinstance(x, tuple) else x for x in node[1:]))
    parts = [x for x in made[1:] if isinstance(x, tuple)]
    if kind not in ("for", "set", "generation", "out") and all(x[0] == "const" for x in parts):
        return ("const", _value(made)({}))
    return made


def _shown(value: Any) -> str:
    return "" if value is None else str(value)


def _value(node: tuple) -> Callable[[dict], Any]:
    """A closure that computes an expression in an environment."""
    kind = node[0]
    if kind == "const":
        return lambda env, value=node[1]: value
    if kind == "name":
        return lambda env, name=node[1]: env.get(name)
    if kind == "filter":
        inner, change = _value(node[1]), FILTERS[node[2]]
        return lambda env: change(_shown(inner(env)))
    if kind == "not":
        inner = _value(node[1])
        return lambda env: not inner(env)
    a, b = _value(node[1]), _value(node[2])
    if kind == "field":
        return lambda env: x.get(b(env)) if isinstance(x := a(env), dict) else None
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "==":
        return lambda env: a(env) == b(env)
    if kind == "!=":
        return lambda env: a(env) != b(env)
    if kind == "in":
        return lambda env: _shown(a(env)) in _shown(b(env))
    return lambda env: x + y if isinstance(x := a(env), int) and isinstance(y := b(env), int) else _shown(x) + _shown(b(env))


Piece = tuple[str, bool]


def _writer(node: tuple, generating: bool = False) -> Callable[[dict], Iterator[Piece]]:
    """A closure that yields the pieces a statement writes."""
    kind = node[0]
    if kind == "text":
        piece = (node[1], generating)
        return lambda env: iter((piece,))
    if kind == "out":
        value = _value(node[1])
        return lambda env: iter(((_shown(value(env)), generating),))
    if kind == "generation":
        return _writer(node[1], True)
    if kind == "set":
        value = _value(node[2])

        def assign(env: dict, name=node[1]) -> Iterator[Piece]:
            env[name] = value(env)
            return iter(())

        return assign
    if kind == "if":
        test, yes, no = _value(node[1]), _writer(node[2], generating), _writer(node[3], generating)
        return lambda env: yes(env) if test(env) else no(env)
    if kind == "for":
        items, body = _value(node[2]), _writer(node[3], generating)

        def loop(env: dict, name=node[1]) -> Iterator[Piece]:
            for k, item in enumerate(items(env) or ()):
                env[name], env["loop"] = item, {"first": k == 0, "index0": k, "index": k + 1}
                yield from body(env)

        return loop
    writers = [_writer(x, generating) for x in node[1]]

    def write(env: dict) -> Iterator[Piece]:
        for each in writers:
            yield from each(env)

    return write


@cache
def compiled(template: str = TEMPLATE) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """messages ({"role", "text"}, any iterable) -> pieces (text, generating), written as they are read.

    A template is parsed, folded and built once a process; rendering keeps no state in it.
    """
    write = _writer(fold(parse(template)))
    return lambda messages: write({"messages": messages})


_START = re.compile(r"<<SYS>>|\[INST\]|<\|turn\|>")
_ENDS = {"<<SYS>>": ("system", "<</SYS>>"), "[INST]": ("user", "[/INST]"), "<|turn|>": (None, "<|end|>")}


def read_back(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, str, int]]:
    """Turns read from what `TEMPLATE` wrote: role, text, the text under the loss mask, characters.

    The last tuple has role None and only characters: what stands outside turns.
    """
    held, mask, begun, outside = "", [], False, 0
    for text, generating in pieces:
        if generating and text:
            mask.append((len(held), len(held) + len(text)))
        held += text
        if not begun and held.startswith("<s>"):
            held, begun, outside = held[3:], True, 3
            mask = [(a - 3, b - 3) for a, b in mask]
        while begun and (turn := _turn(held)):
            role, said, end = turn
            yield role, unescape(said), "".join(unescape(held[a:b]) for a, b in mask if b <= end), end
            held, mask = held[end:], [(a - end, b - end) for a, b in mask if b > end]
    if held:
        raise ValueError("the formatted text ends within a turn")
    yield None, "", "", outside


def _turn(held: str) -> tuple[str, str, int] | None:
    m = _START.match(held)
    if not m:
        end = held.find("</s>")
        return ("assistant", held[:end], end + 4) if end >= 0 else None
    role, mark = _ENDS[m[0]]
    end = held.find(mark, m.end())
    if end < 0:
        return None
    said = held[m.end() : end]
    if role is None:
        name, _, said = said.partition("<|text|>")
        role = unescape(name)
    return role, said, end + len(mark)


def _streamed(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, made: Callable, schema: str) -> DataFrame:
    """`made(messages)` -> a row's values, for each conversation in the order of turn, role and text."""
    rows = conversations.select(F.col(id_col).alias("c"), F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.col(text_col).alias("x"))
    rows = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")
    kind = conversations.schema[id_col].dataType.simpleString()
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list = []

        def flat() -> Iterator[tuple]:
            for batch in batches:
                types[:] = [batch.schema.field(0).type]
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)

        stream = flat()
        ahead = next(stream, None)
        out: list[tuple] = []

        def turns(conv: Any) -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                yield {"role": ahead[1] or "", "text": ahead[2] or ""}
                ahead = next(stream, None)

        held = 0
        while ahead is not None:
            conv = ahead[0]
            said = turns(conv)
            row = made(said)
            for _ in said:  # a template need not read all messages
                pass
            out.append((conv, *row))
            held += sum(len(v) for v in row if isinstance(v, str))
            if len(out) >= 2000 or held > 4_000_000 or ahead is None:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({"c": pa.array(columns[0], types[0])} | {n: pa.array(v) for n, v in zip(names, columns[1:], strict=True)})
                out, held = [], 0

    return arrow_map(rows, run, f"c {kind}, {schema}").withColumnRenamed("c", id_col)


def format_conversations(
    conversations: DataFrame, template: str = TEMPLATE, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: its formatted text and loss_spans, character ranges "start:end" under the loss mask.

    Null texts and roles count as empty; rows with a null id form one conversation; null turns come first and equal
    turns are ordered by role and text; repeated rows are repeated turns; an empty table gives no rows.
    """

    def made(messages: Iterator[dict]) -> tuple:
        parts, spans, at = [], [], 0
        for text, generating in compiled(template)(messages):
            if generating and text:
                spans.append(f"{at}:{at + len(text)}")
            parts.append(text)
            at += len(text)
        return "".join(parts), ",".join(spans)

    return _streamed(conversations, id_col, turn_col, role_col, text_col, made, "formatted string, loss_spans string")


def digests(
    conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation with digests of what is read back from its formatted text, turn by turn."""

    def made(messages: Iterator[dict]) -> tuple:
        turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for role, text, masked, size in read_back(compiled()(messages)):
            chars += size
            if role is None:
                break
            n += 1
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            loss.update(masked.encode("utf-8", "surrogatepass"))
            loss_chars += len(masked)
        return n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    schema = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _streamed(conversations, id_col, turn_col, role_col, text_col, made, schema)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{said}' as text")
    return digests(rows.unionByName(more))


QUERIES = {"op4_chat_format": op4_chat_format}
ORACLES = {"op4_chat_format": OP4}
