"""Functions over proof texts whose grammar isn't regular: steps, comments, binders, statements.

Plain Python on single texts first; the column functions at the end run them on Arrow batches.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OPENERS = (" by", " where", " do", " =>")
HEADERS = ("theorem ", "lemma ", "example ")
REMARKS = ("--", "/-", "-/")
LINK = "<;>"
BULLETS = "·∙"
NET = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}


class Line(NamedTuple):
    indent: int
    text: str


def lines_of(text: str) -> list[Line]:
    return [Line(len(x) - len(x.lstrip()), x.strip()) for x in text.split("\n")]


def inside_fence(text: str) -> str:
    """What the code fence around a text holds; the text itself where it starts with none."""
    if not text.lstrip().startswith("```"):
        return text
    kept = []
    for line in text.split("\n")[1:]:
        if line.lstrip().startswith("```"):
            break
        kept.append(line)
    return "\n".join(kept)


def open_brackets(text: str) -> int:
    return sum(NET.get(c, 0) for c in text)


def opens_block(text: str) -> bool:
    return text == "by" or text.endswith(OPENERS)


# -- the first step ------------------------------------------------------------------------------


def first_step(text: str) -> str:
    """The first step of a generated text: one line, with its block or until its brackets close."""
    lines = lines_of(inside_fence(text.rstrip()))
    at = next((i for i, x in enumerate(lines) if x.text and not x.text.startswith(REMARKS[:2])), None)
    if at is None:
        return ""
    if lines[at].text == "·":
        at = next((i for i in range(at + 1, len(lines)) if lines[i].text), None)
        if at is None:
            return ""
        head = lines[at].text
    else:
        head = lines[at].text.removeprefix("· ")
    below = []
    for x in lines[at + 1 :]:
        if not x.text:
            break
        below.append(x)
    kept = [head]
    if opens_block(head):
        for x in below:
            if x.indent <= lines[at].indent or x.indent < below[0].indent:
                break
            kept.append(x.text)
    elif (depth := open_brackets(head)) > 0:
        for x in below:
            kept.append(x.text)
            depth += open_brackets(x.text)
            if depth <= 0:
                break
    return "\n".join(kept).strip()


# -- all steps -----------------------------------------------------------------------------------


def flat_steps(text: str) -> list[str]:
    """Every line that isn't blank, a remark or a declaration; of a declaration what follows its last ``by``."""
    out = []
    for x in lines_of(inside_fence(text.strip())):
        if not x.text or x.text.startswith(REMARKS):
            continue
        if x.text.startswith(HEADERS):
            _, by, rest = x.text.rpartition(" by ")
            out += [rest.strip()] if by and rest.strip() else []
        else:
            out.append(x.text)
    return out


def _linked_below(lines: list[Line], at: int) -> bool:
    """Whether the lines from ``at`` on go on with a chain: ``<;> …``, or ``<;>`` alone before ``… <;>``."""
    bare = False
    for x in lines[at:]:
        if x.text == LINK:
            bare = True
        elif x.text:
            return x.text.startswith(LINK + " ") or (bare and x.text.endswith(LINK))
    return False


def _calc(lines: list[Line], at: int) -> tuple[list[str], int]:
    kept, end = [lines[at].text], at + 1
    while end < len(lines) and (not lines[end].text or lines[end].indent > lines[at].indent or lines[end].text[0] == "_"):
        kept += [lines[end].text] if lines[end].text else []
        end += 1
    return ["\n".join(kept)], end


def _body(lines: list[Line], at: int) -> tuple[list[Line], int]:
    """The lines below a block's opener, and where they end: deeper ones, arms and ``_`` lines."""
    body, end = [], at + 1
    while end < len(lines):
        x = lines[end]
        if x.text:
            if x.indent <= lines[at].indent and x.text[0] not in "|_":
                break
            body.append(x)
        else:
            following = next((y for y in lines[end:] if y.text), None)
            if following is None or following.indent <= lines[at].indent:
                break
        end += 1
    return body, end


def _block(lines: list[Line], at: int, split: bool) -> tuple[list[str], int]:
    head = lines[at].text
    body, end = _body(lines, at)
    if split and len(body) > 1 and (goal := stated_goal(head)):
        return [goal, *_steps(body, False)], end
    if len(body) == 1 and (head == "by" or head.endswith(" by")):
        return [f"{head} {body[0].text}"], end
    return ["\n".join([head, *(" " * (2 + max(0, x.indent - body[0].indent)) + x.text for x in body)])], end


def _brackets(lines: list[Line], at: int) -> tuple[list[str], int]:
    kept, end, depth = [lines[at].text], at + 1, open_brackets(lines[at].text)
    while depth > 0 and end < len(lines) and lines[end].text:
        kept.append(lines[end].text)
        depth += open_brackets(lines[end].text)
        end += 1
    return ["\n".join(kept)], end


def _chain(lines: list[Line], at: int) -> tuple[list[str], int]:
    """Steps that ``<;>`` links over several lines, as one; a link that leads nowhere goes if it is the only one."""
    cut = lambda t: t.removesuffix(LINK).rstrip()
    parts, end, dangling = [cut(lines[at].text)], at + 1, True
    while dangling and end < len(lines) and lines[end].text:
        x = lines[end]
        if x.text == LINK:
            after = lines[end + 1] if end + 1 < len(lines) else Line(0, "")
            if not (_linked_below(lines, end + 1) or (after.text and not after.text.startswith(LINK) and after.indent >= lines[at].indent)):
                break
            end += 1
            continue
        leads = x.text.startswith(LINK + " ")
        if not leads and x.indent < lines[at].indent:
            break
        piece = x.text.removeprefix(LINK + " ")
        end += 1
        parts.append(cut(piece))
        dangling = piece.endswith(LINK)
        if leads:
            if not _linked_below(lines, end):
                break
            dangling = True
    joined = f" {LINK} ".join(parts)
    return [f"{joined} {LINK}" if dangling and LINK in joined else joined], end


def stated_goal(head: str) -> str | None:
    """``have h : T := by`` and ``let x : T by`` without the proof; None where no type is given."""
    found = re.fullmatch(r"((?:have|let) .*?)\s*(?::=)?\s*(?<=[\s=])by", head)
    return found[1].rstrip() if found and " : " in found[1] else None


def _steps(lines: list[Line], split: bool) -> list[str]:
    out, at = [], 0
    while at < len(lines):
        text = lines[at].text
        if not text or text.startswith(REMARKS) or text.startswith(HEADERS):
            at += 1
            continue
        if text.startswith("calc"):
            found, at = _calc(lines, at)
        elif opens_block(text) or text.startswith("match "):
            found, at = _block(lines, at, split)
        elif open_brackets(text) > 0:
            found, at = _brackets(lines, at)
        elif (text.endswith(LINK) and text != LINK) or _linked_below(lines, at + 1):
            found, at = _chain(lines, at)
        else:
            found, at = [text], at + 1
        out += found
    bare = [re.sub(rf"^\s*[{BULLETS}]+\s*(?=\S)", "", t) for t in out]
    return [t for t in bare if t.strip() not in ("", LINK, "·", ".")]


def steps(text: str) -> list[str]:
    """The steps of a generated text, for replay one by one.

    Fences, remarks and declarations go. ``calc``, ``match`` and blocks hold their lines; a block of
    one line joins its opener. A ``have`` or ``let`` with a type and a longer block becomes the goal
    it states, then the block's steps (inner blocks stay whole). Open brackets take lines until they
    close; ``<;>`` chains become one line; bullets at the start go.
    """
    return _steps(lines_of(inside_fence(text.rstrip())), True)


# -- sources -------------------------------------------------------------------------------------


def uncommented(text: str) -> str:
    """Without comments, nested ones included; line breaks stay, so lines keep their numbers."""
    depth, out, last = 0, [], 0
    for m in re.finditer(r"/-|-/|\n", text):
        if depth == 0:
            out.append(text[last : m.start()])
        token, last = m[0], m.end()
        if token == "\n":
            out.append("\n")
        elif token == "/-":
            depth += 1
        elif depth:
            depth -= 1
        else:
            out.append(token)
    if depth == 0:
        out.append(text[last:])
    return "\n".join(line.partition("--")[0] for line in "".join(out).split("\n"))


def proof_lines(text: str) -> list[str]:
    """Lines in the proofs of a source: all that isn't blank after the first ``:= by``, declarations left out."""
    out, inside = [], False
    for line in uncommented(text).split("\n"):
        _, opened, rest = line.partition(":= by")
        inside = inside or bool(opened)
        words = rest.strip() if opened else line.strip()
        if inside and words:
            out.append(words)
    return out


def integrity(text: str) -> dict:
    """contaminated, reasons, suspicious, trivial, tactic_count of a source."""
    found = proof_lines(text)
    reasons = dict.fromkeys(f"{w} in tactic: {x[:100]}" for x in found for w in re.findall(r"\b(?:sorry|admit|cheat|sorryAx)\b", x))
    return {
        "contaminated": bool(reasons), "reasons": list(reasons),
        "suspicious": [f"Decidable.decide in: {x[:100]}" for x in found if re.search(r"\bDecidable\.decide\b", x)],
        "trivial": len(found) == 1 and found[0].rstrip(";").strip() in ("trivial", "rfl", "decide"), "tactic_count": len(found)}


def top_steps(text: str) -> list[str]:
    """Steps at the indent of the first line (or less) with the deeper lines below them; comments left out."""
    out: list[list[str]] = []
    base, commented = None, False
    for x in lines_of(text):
        if commented or x.text.startswith("/-"):
            commented = "-/" not in (x.text if commented else x.text[2:])
        elif x.text and not x.text.startswith("--"):
            base = x.indent if base is None else base
            if x.indent <= base or not out:
                out.append([])
            out[-1].append(x.text)
    return ["\n".join(step) for step in out]


def proof_heads(text: str) -> list[str]:
    """The first words of the steps of a source's first proof, ``<;>`` parts each; lines inside open brackets left out."""
    opened = re.search(r":=\s*by\b", text := re.sub(r"/-.*?-/", "", text, flags=re.S))
    out, depth = [], 0
    for line in text[opened.end() :].split("\n") if opened else []:
        line = line.strip()
        if not line or line.startswith("--"):
            continue
        if depth == 0:
            for part in line.split(LINK):
                part = part.strip().removeprefix("·").strip()
                if part and not part.startswith("--") and (head := part.split()[0].strip("()")) not in ("", "|"):
                    out.append(head)
        depth = max(0, depth + sum(NET[c] for c in line if c in "[]"))
        depth = max(0, depth + sum(NET[c] for c in line if c in "()"))
    return out


# -- statements ----------------------------------------------------------------------------------


def groups(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the outermost bracket groups."""
    depth = start = 0
    for i, c in enumerate(text):
        step = NET.get(c, 0)
        if step > 0 and depth == 0:
            start = i
        depth = max(0, depth + step)
        if step < 0 and depth == 0:
            yield start, i + 1


def as_expression(signature: str) -> str:
    """``(x : T) (h : P) : goal`` as ``∀ (x : T) (h : P), goal``.

    The goal starts at the last colon outside of brackets that directly follows a closing one and
    isn't that of ``:=``; without such a colon all is goal.
    """
    at = -1
    for _, end in groups(signature):
        rest = signature[end:].lstrip()
        if rest.startswith(":") and not rest.startswith(":="):
            at = len(signature) - len(rest)
    if at < 0:
        goal = " ".join(signature.split())
        return goal.lstrip(":").strip() if goal.startswith(":") else goal
    binders = " ".join(signature[:at].split())
    goal = re.sub(r"[ \t]+", " ", signature[at + 1 :].strip())
    return f"∀ {binders}, {goal}" if binders else goal


def binder_names(binders: str) -> list[str]:
    """The names that binder groups with a colon bind."""
    out = []
    for start, end in groups(binders):
        names, colon, _ = binders[start + 1 : end - 1].partition(":")
        out += [n for n in names.split() if n.isidentifier() or n[0] in "h_"] if colon else []
    return out


def leading_groups(text: str, brackets: str) -> int:
    """Where the bracket groups that ``text`` begins with, and the blanks around them, end."""
    pair = rf"[{re.escape(brackets[::2])}]", rf"[{re.escape(brackets[1::2])}]"
    depth, end = 0, 0
    for m in re.finditer(rf"(?P<open>{pair[0]})|(?P<close>{pair[1]})|(?P<other>\S)", text):
        depth += bool(m["open"]) - bool(m["close"])
        if depth <= 0 and m["other"]:
            return m.start()
        end = m.end()
    return max(end, len(text))


def signature_as_expression(signature: str) -> str:
    """``(a : T) [i] : P`` as ``∀ (a : T) [i], P``; a signature without a colon behind its groups is an expression already."""
    text = signature.strip()
    at = leading_groups(text, "()[]{}⟨⟩")
    if text[at : at + 1] != ":":
        return text
    binders, goal = text[:at].strip(), text[at + 1 :].strip()
    return f"∀ {binders}, {goal}" if binders else goal


def typed_as_expression(typed: str) -> str:
    """As :func:`signature_as_expression`, over parentheses and braces only; a comma may stand for the colon."""
    at = leading_groups(typed, "(){}")
    if typed[at : at + 1] not in (":", ","):
        return typed.strip()
    binders, goal = typed[:at].strip(), typed[at + 1 :].strip()
    return f"∀ {binders}, {goal}" if binders else goal


def typed_declarations(source: str) -> list[dict]:
    """name, statement of each theorem and lemma that begins a line: the text up to ``:= by`` (or ``:=``), without line comments."""
    out = []
    for part in re.split(r"(?m)^(?=(?:theorem|lemma)\b)", source):
        if m := re.match(r"(?:theorem|lemma)\s+(\S+)", part):
            head, sign, _ = (rest := part[m.end() :]).partition(":= by")
            if not sign:
                head, sign, _ = rest.partition(":=")
            if sign:
                bare = re.sub(r"\n\s*\n", "\n", re.sub("--[^\n]*", "", head.strip())).strip()
                out.append({"name": m[1], "statement": typed_as_expression(bare)})
    return out


def _blocks(source: str) -> list[list[str]]:
    """The declarations of a source without its comments: kind (with modifiers passed over), name and the whole text of each that begins a line."""
    out, held = [], []
    for line in [re.split("--", x)[0] for x in uncommented(source).split("\n")] + ["#"]:
        first = (line.split() or [""])[0] if line[:1].strip() else ""
        if first in ("theorem", "lemma", "abbrev", "def", "noncomputable", "instance", "open", "end", "section", "namespace", "variable", "#") or first.startswith("#"):
            if words := " ".join(held).split():
                at = int(words[0] == "noncomputable")
                out.append([*(words[at : at + 2] + ["", ""])[:2], "\n".join(held).strip()])
            held = []
        held.append(line)
    return out


def definitions(source: str) -> list[str]:
    """What a source's theorems need: answers left open, with single blanks, then other definitions as they stand."""
    blocks = _blocks(source)
    answers = []
    for kind, name, text in blocks:
        head, sign, value = text.rpartition(":=")
        if kind == "abbrev" and name.endswith("_solution") and sign and value.split()[:1] == ["sorry"]:
            answers.append(" ".join(head.split()) + " := sorry")
    return answers + [text for kind, _, text in blocks if kind == "def" and "_solution" not in text]


def declarations(text: str) -> list[dict]:
    """name, statement of the theorems of a source that are left open (``sorry``)."""
    out = []
    for part in re.split(r"\btheorem\s", text)[1:]:
        name = (part.split() or [""])[0]
        cut = next((i for i, c in enumerate(name) if not (c.isalnum() or c in "_'.")), len(name))
        rest = part.lstrip()[cut:].split(":=")
        # the first value that gives up at once ends the statement
        for k, value in enumerate(rest[1:], 1):
            if cut and ["sorry"] == [w for w in value.split()[:2] if w != "by"][:1]:
                if statement := as_expression(":=".join(rest[:k]).strip()):
                    out.append({"name": name[:cut], "statement": statement})
                break
    return out


def proofs_of(text: str, mark: str = r"(?m)^-- proof (\S+)[^\n]*$") -> list[dict]:
    """The proofs of a file of many, each behind a line that ``mark`` matches (its group: the proof's id).

    Proofs that give up in their steps and parts without a theorem are left out.
    """
    parts = re.split(mark, text)
    out = []
    for name, body in zip(parts[1::2], parts[2::2]):
        m = re.search(r"theorem\s+(\w+)\s*((?:\([^)]*\)\s*|\{[^}]*\}\s*|\[[^\]]*\]\s*)*)\s*:\s*(.*?)\s*:=\s*by\b(.*)", body.strip(), re.S)
        if m and not re.search(r"\b(?:sorry|admit|cheat|sorryAx)\b", re.sub(r"/-.*?-/", "", m[4], flags=re.S)):
            out.append({"proof_id": name, "theorem": m[1], "binders": m[2].strip(), "names": binder_names(m[2]), "goal": m[3].strip(), "proof": m[4]})
    return out


def state_as_statement(state: str) -> str | None:
    """A root state as a statement: hypotheses with a type become binders, lines of the goal are joined."""
    lines = state.strip().split("\n")
    at = next((i for i, x in enumerate(lines) if x.startswith("⊢")), None)
    if at is None:
        return None
    goal = " ".join([lines[at][2:].strip(), *(x.strip() for x in lines[at + 1 :])])
    binders = " ".join(f"({x.strip()})" for x in lines[:at] if " : " in x.strip())
    return f"∀ {binders}, {goal}" if binders else goal


# -- columns -------------------------------------------------------------------------------------


def _column(function: Callable, kind: str) -> Callable[[Column], Column]:
    """The function on a text column, batch by batch; null for null."""
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return run


def _rows(function: Callable, kind: str) -> Callable[[Column], Column]:
    """As :func:`_column`, for functions that return dicts."""
    fields = [f.split(" ")[0] for f in kind.split(", ")]

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dict.fromkeys(fields) if t is None else function(t) for t in texts], columns=fields)

    return run


def first_step_of(c: Column) -> Column:
    return _column(first_step, "string")(c)


def steps_of(c: Column) -> Column:
    return _column(steps, "array<string>")(c)


def flat_steps_of(c: Column) -> Column:
    return _column(flat_steps, "array<string>")(c)


def top_steps_of(c: Column) -> Column:
    return _column(top_steps, "array<string>")(c)


def proof_heads_of(c: Column) -> Column:
    return _column(proof_heads, "array<string>")(c)


def uncommented_of(c: Column) -> Column:
    return _column(uncommented, "string")(c)


def proof_lines_of(c: Column) -> Column:
    return _column(proof_lines, "array<string>")(c)


def integrity_of(c: Column) -> Column:
    """A struct; all of its fields are null for a null source."""
    return _rows(integrity, "contaminated boolean, reasons array<string>, suspicious array<string>, trivial boolean, tactic_count int")(c)


def expression_of(c: Column) -> Column:
    return _column(as_expression, "string")(c)


def binder_names_of(c: Column) -> Column:
    return _column(binder_names, "array<string>")(c)


def declarations_of(c: Column) -> Column:
    return _column(declarations, "array<struct<name:string,statement:string>>")(c)


def proofs_in(c: Column) -> Column:
    return _column(proofs_of, "array<struct<proof_id:string,theorem:string,binders:string,names:array<string>,goal:string,proof:string>>")(c)


def statement_of(c: Column) -> Column:
    return _column(state_as_statement, "string")(c)


def signature_of(c: Column) -> Column:
    return _column(signature_as_expression, "string")(c)


def typed_of(c: Column) -> Column:
    return _column(typed_as_expression, "string")(c)


def typed_declarations_of(c: Column) -> Column:
    return _column(typed_declarations, "array<struct<name:string,statement:string>>")(c)


def definitions_of(c: Column) -> Column:
    return _column(definitions, "array<string>")(c)
