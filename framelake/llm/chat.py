"""Chat formatting by a template compiler.

The template language is sandboxed: text, {{ expression }}, {% if %}/{% elif %}/{% else %}/{% endif %},
{% for name in messages %}/{% endfor %} and {% generation %}/{% endgeneration %}. Expressions know string
literals, + (joining), == and !=, not/and/or, names, name.field (a mapping's entry, never an attribute)
and the filters escape, trim, upper, lower. A template is parsed into a syntax tree, constants are folded
(joined literals, filters and comparisons of constants, branches that are never or always taken, runs of
text), and the tree becomes Python closures, which yield (text, under the loss mask?) pieces one by one.

escape makes texts that hold control strings safe and reversible: each backslash is doubled, and a
backslash and "!" go behind the first character of each control string. So no control string is left in a
text, and unescape() brings the text back. Rendering is by the piece: a conversation of any length streams.

Nulls: a null text or role is an empty one; rows without conv_id are one conversation. Rows with the same
turn are ordered by role, then text; equal rows stay. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TEMPLATE = (
    "{% for m in messages %}{{ '<s>' + '[INST]' }}{{ m.role | escape }}{{ '[/INST]' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '</s>' }}{% endfor %}"
)

# --- parsing ---------------------------------------------------------------------------------------

TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
LEXEME = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_]\w*)|(==|!=|[+|.()]))""")


class TemplateError(ValueError):
    pass


def _lex(code: str) -> list[str]:
    out, at = [], 0
    code = code.rstrip()
    while at < len(code):
        m = LEXEME.match(code, at)
        if not m:
            raise TemplateError(f"can't read {code[at:]!r}")
        out.append(m[1] or m[2] or m[3])
        at = m.end()
    return out


#: What a literal's backslash pairs mean (fixed values).
PAIRS = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class _Expression:
    """Recursive descent over one expression. Trees are tuples, their first entry the kind."""

    def __init__(self, code: str) -> None:
        self.words, self.at = _lex(code), 0

    def peek(self) -> str | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def next(self, want: str | None = None) -> str:
        word = self.peek()
        if word is None or want and word != want:
            raise TemplateError(f"expected {want or 'more'}, found {word}")
        self.at += 1
        return word

    def whole(self) -> tuple:
        tree = self.either()
        if self.peek() is not None:
            raise TemplateError(f"unexpected {self.peek()}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.peek() == "or":
            self.next()
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.inverse()
        while self.peek() == "and":
            self.next()
            tree = ("and", tree, self.inverse())
        return tree

    def inverse(self) -> tuple:
        if self.peek() == "not":
            self.next()
            return ("not", self.inverse())
        tree = self.joined()
        if self.peek() in ("==", "!="):
            return (self.next(), tree, self.joined())
        return tree

    def joined(self) -> tuple:
        tree = self.filtered()
        while self.peek() == "+":
            self.next()
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.atom()
        while self.peek() == "|":
            self.next()
            name = self.next()
            if name not in ("escape", "trim", "upper", "lower"):
                raise TemplateError(f"no filter {name}")
            tree = ("filter", name, tree)
        return tree

    def atom(self) -> tuple:
        word = self.next()
        if word == "(":
            tree = self.either()
            self.next(")")
            return tree
        if word[0] in "'\"":
            return ("text", re.sub(r"\\(.)", lambda m: PAIRS.get(m[1], m[0]), word[1:-1]))
        if not word.isidentifier():
            raise TemplateError(f"unexpected {word}")
        tree = ("name", word)
        while self.peek() == ".":
            self.next()
            tree = ("field", tree, self.next())
        return tree


def parse(source: str) -> list[tuple]:
    """The syntax tree: ("out", expression), ("if", [(test, body), ...]), ("for", name, expression, body), ("generation", body)."""
    stack: list[tuple[str, list]] = [("top", [])]
    open_tags: list[list] = []
    for part in TAG.split(source):
        body = stack[-1][1]
        if part.startswith("{{"):
            body.append(("out", _Expression(part[2:-2]).whole()))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            if word == "if":
                open_tags.append([(_Expression(rest).whole(), [])])
                stack.append(("if", open_tags[-1][-1][1]))
            elif word in ("elif", "else") and stack[-1][0] == "if":
                stack.pop()
                open_tags[-1].append((_Expression(rest).whole() if word == "elif" else ("text", "else"), []))
                stack.append(("if", open_tags[-1][-1][1]))
            elif word == "endif" and stack[-1][0] == "if":
                stack.pop()
                stack[-1][1].append(("if", open_tags.pop()))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"can't read for {rest}")
                inner: list = []
                body.append(("for", m[1], _Expression(m[2]).whole(), inner))
                stack.append(("for", inner))
            elif word == "generation":
                inner = []
                body.append(("generation", inner))
                stack.append(("generation", inner))
            elif word in ("endfor", "endgeneration") and stack[-1][0] == word[3:]:
                stack.pop()
            else:
                raise TemplateError(f"misplaced {word}")
        elif part:
            body.append(("out", ("text", part)))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return stack[0][1]


# --- folding ---------------------------------------------------------------------------------------


def escaper(control: tuple[str, ...]) -> tuple[Callable[[str], str], Callable[[str], str]]:
    """escape and unescape for these control strings."""
    found = re.compile("|".join(re.escape(c) for c in sorted(control, key=len, reverse=True)))

    def escape(text: str) -> str:
        return found.sub(lambda m: m[0][0] + "\\!" + m[0][1:], text.replace("\\", "\\\\"))

    def unescape(text: str) -> str:
        return re.sub(r"\\([\\!])", lambda m: "\\" if m[1] == "\\" else "", text)

    return escape, unescape


def _filters(control: tuple[str, ...]) -> dict[str, Callable[[str], str]]:
    return {"escape": escaper(control)[0], "trim": str.strip, "upper": str.upper, "lower": str.lower}


def fold(tree: tuple, filters: dict[str, Callable[[str], str]]) -> tuple:
    """An expression with its constant parts worked out."""
    kind = tree[0]
    if kind == "filter":
        inner = fold(tree[2], filters)
        return ("text", filters[tree[1]](inner[1])) if inner[0] == "text" else ("filter", tree[1], inner)
    if kind == "field":
        return ("field", fold(tree[1], filters), tree[2])
    if kind in ("+", "==", "!=", "and", "or"):
        a, b = fold(tree[1], filters), fold(tree[2], filters)
        if a[0] == b[0] == "text":
            if kind == "+":
                return ("text", a[1] + b[1])
            if kind in ("==", "!="):
                return ("text", "true" if (a[1] == b[1]) == (kind == "==") else "")
        if kind in ("and", "or") and a[0] == "text":
            return b if bool(a[1]) == (kind == "and") else a
        return (kind, a, b)
    if kind == "not":
        inner = fold(tree[1], filters)
        return ("text", "" if inner[1] else "true") if inner[0] == "text" else ("not", inner)
    return tree


def fold_body(body: list[tuple], filters: dict[str, Callable[[str], str]]) -> list[tuple]:
    """A body with folded expressions, decided branches and joined texts."""
    out: list[tuple] = []
    for node in body:
        if node[0] == "out":
            fresh = [("out", fold(node[1], filters))]
        elif node[0] == "if":
            arms, fresh = [], None
            for test, inner in node[1]:
                test = fold(test, filters)
                if test[0] == "text" and not test[1]:
                    continue
                arms.append((test, fold_body(inner, filters)))
                if test[0] == "text":
                    break
            if arms and arms[0][0][0] == "text":
                fresh = arms[0][1]
            elif arms:
                fresh = [("if", arms)]
        elif node[0] == "for":
            fresh = [("for", node[1], fold(node[2], filters), fold_body(node[3], filters))]
        else:
            fresh = [("generation", fold_body(node[1], filters))]
        for n in fresh or []:
            if n[0] == "out" and n[1] == ("text", ""):
                continue
            if out and n[0] == out[-1][0] == "out" and n[1][0] == out[-1][1][0] == "text":
                out[-1] = ("out", ("text", out[-1][1][1] + n[1][1]))
            else:
                out.append(n)
    return out


# --- closures --------------------------------------------------------------------------------------

Piece = tuple[str, bool]


def _value(tree: tuple, filters: dict) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "text":
        return lambda names, v=tree[1]: v
    if kind == "name":
        return lambda names, n=tree[1]: names.get(n, "")
    if kind == "field":
        inner, key = _value(tree[1], filters), tree[2]

        def field(names: dict) -> object:
            held = inner(names)
            return held.get(key, "") if isinstance(held, dict) else ""

        return field
    if kind == "filter":
        inner, run = _value(tree[2], filters), filters[tree[1]]
        return lambda names: run(str(inner(names)))
    if kind == "not":
        inner = _value(tree[1], filters)
        return lambda names: "" if inner(names) else "true"
    a, b = _value(tree[1], filters), _value(tree[2], filters)
    return {
        "+": lambda names: str(a(names)) + str(b(names)),
        "==": lambda names: "true" if a(names) == b(names) else "",
        "!=": lambda names: "true" if a(names) != b(names) else "",
        "and": lambda names: a(names) and b(names),
        "or": lambda names: a(names) or b(names),
    }[kind]


def _render(body: list[tuple], filters: dict) -> Callable[[dict, bool], Iterator[Piece]]:
    steps: list[Callable[[dict, bool], Iterator[Piece]]] = []
    for node in body:
        if node[0] == "out":
            value = _value(node[1], filters)

            def out(names: dict, loss: bool, value=value) -> Iterator[Piece]:
                yield str(value(names)), loss

            steps.append(out)
        elif node[0] == "if":
            arms = [(_value(t, filters), _render(b, filters)) for t, b in node[1]]

            def branch(names: dict, loss: bool, arms=arms) -> Iterator[Piece]:
                for test, run in arms:
                    if test(names):
                        yield from run(names, loss)
                        return

            steps.append(branch)
        elif node[0] == "for":
            name, over, run = node[1], _value(node[2], filters), _render(node[3], filters)

            def loop(names: dict, loss: bool, name=name, over=over, run=run) -> Iterator[Piece]:
                for item in over(names):
                    yield from run({**names, name: item}, loss)

            steps.append(loop)
        else:
            inner = _render(node[1], filters)
            steps.append(lambda names, loss, inner=inner: inner(names, True))

    def every(names: dict, loss: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(names, loss)

    return every


def compiled(source: str, control: tuple[str, ...] = CONTROL) -> Callable[[Iterator[dict]], Iterator[Piece]]:
    """render(messages): the pieces of a conversation; messages may be an iterator."""
    filters = _filters(control)
    run = _render(fold_body(parse(source), filters), filters)
    return lambda messages: run({"messages": messages}, False)


# --- over a table ----------------------------------------------------------------------------------

FORMATTED = "conv_id bigint, part bigint, text string, loss array<struct<start:bigint,stop:bigint>>, last boolean"
PART_CHARS = 1 << 20


def formatted(conversations: DataFrame, template: str = TEMPLATE, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """conv_id, part, text, loss, last: each conversation's formatted text, in parts of about 1 M characters.

    loss holds the spans under the loss mask, in code points of the part. Parts of a conversation stand in
    order in one partition, one after another.
    """
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select(F.col("conv_id").cast("string").alias("name"), "role", "text")  # pandas would make nullable integers floats

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compiled(template, control)
        stream = (row for f in frames for row in zip(f["name"], f["role"], f["text"]))
        ahead = next(stream, None)
        out: list[tuple] = []
        held = 0
        while ahead is not None:
            name = ahead[0]
            conv = None if name is None else int(name)

            def messages() -> Iterator[dict]:
                nonlocal ahead
                while ahead is not None and ahead[0] == name:
                    row, ahead = ahead, next(stream, None)
                    yield {"role": row[1], "text": row[2]}

            text, loss, size, part = [], [], 0, 0
            for piece, masked in render(messages()):
                if size > PART_CHARS:
                    out.append((conv, part, "".join(text), loss, False))
                    held += size
                    text, loss, size, part = [], [], 0, part + 1
                if masked:
                    loss.append((size, size + len(piece)))
                text.append(piece)
                size += len(piece)
            for _ in messages():  # a template need not read them all
                pass
            out.append((conv, part, "".join(text), loss, True))
            held += size
            if held > 4 * PART_CHARS or len(out) >= 1000:
                yield _frame(out)
                out, held = [], 0
        if out:
            yield _frame(out)

    return rows.mapInPandas(run, FORMATTED)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    conv, part, text, loss, last = zip(*rows)
    return pd.DataFrame({"conv_id": pd.array(conv, dtype="Int64"), "part": part, "text": text, "loss": [[{"start": a, "stop": b} for a, b in x] for x in loss], "last": last})


TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)


def read_back(texts: DataFrame, control: tuple[str, ...] = CONTROL) -> DataFrame:
    """Per conversation, from the formatted text and its loss spans alone: the turns' and the loss text's digests."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unescape = escaper(control)[1]
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = size = 0
        rest = ""
        for f in frames:
            out = []
            for conv, text, spans, last in zip(f["conv_id"], f["text"], f["loss"], f["last"]):
                size += len(text)
                for s in spans:
                    own = unescape(text[s["start"] : s["stop"]])
                    chars += len(own)
                    loss.update(own.encode())
                rest += text
                at = 0
                for m in TURN.finditer(rest):
                    n, at = n + 1, m.end()
                    turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                rest = rest[at:]
                if last:
                    if rest:
                        raise ValueError("text that isn't a turn")
                    out.append((None if pd.isna(conv) else int(conv), n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n = chars = size = 0
            if out:
                cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
                yield pd.DataFrame(out, columns=cols).astype({"conv_id": "Int64"})

    return texts.mapInPandas(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def conversation_digests(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    return read_back(formatted(conversations))
