"""Answers of servers and logs of compilers, and settings that change with depth, as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VARS = "array<struct<userName:string,name:string,type:struct<pp:string>>>"
_GOALS = f"array<struct<vars:{_VARS},target:struct<pp:string>>>"
#: fixed values: bare names and their full ones
FULL_NAMES = {
    "sin": "Real.sin", "cos": "Real.cos", "tan": "Real.tan", "exp": "Real.exp", "log": "Real.log", "sqrt": "Real.sqrt",
    "arctan": "Real.arctan", "arcsin": "Real.arcsin", "arccos": "Real.arccos", "pi": "Real.pi",
    "choose": "Nat.choose", "factorial": "Nat.factorial", "gcd": "Nat.gcd", "lcm": "Nat.lcm", "Coprime": "Nat.Coprime",
}


def with_full_names(statement: Column) -> Column:
    """Bare names, no part of longer ones, replaced by their full names; ``exp.`` stays."""
    out = statement
    word = r"\p{L}\p{N}_"
    for bare, full in FULL_NAMES.items():
        after = f"[.{word}]" if bare == "exp" else f"[{word}]"
        out = F.regexp_replace(out, rf"(?<![.{word}]){bare}(?!{after})", full)
    return out


def goals_text(goals: Column) -> Column:
    """Goals in JSON as a state: ``name : type`` lines, then the target, goals apart by an empty line; ? for what lacks."""
    shown = lambda c: F.coalesce(c, F.lit("?"))

    def one(g: Column) -> Column:
        lines = F.transform(F.coalesce(g["vars"], F.array().cast(_VARS)), lambda v: F.concat(shown(F.coalesce(v["userName"], v["name"])), F.lit(" : "), shown(v["type"]["pp"])))
        return F.array_join(F.concat(lines, F.array(F.concat(F.lit("⊢ "), shown(g["target"]["pp"])))), "\n")

    return F.array_join(F.transform(F.from_json(goals, _GOALS), one), "\n\n")


def generated(body: Column, most_tokens: int) -> Column:
    """text, log_prob (sum over output tokens), n_tokens, truncated of a generation server's answer."""
    r = F.from_json(body, "text string, meta_info struct<output_token_logprobs:array<array<string>>>")
    tokens = r["meta_info"]["output_token_logprobs"]
    n = F.greatest(F.size(F.coalesce(tokens, F.array().cast("array<array<string>>"))), F.lit(0))
    total = F.aggregate(F.coalesce(tokens, F.array().cast("array<array<string>>")), F.lit(0.0), lambda s, t: s + F.coalesce(F.get(t, F.lit(0)).try_cast("double"), F.lit(0.0)))
    return F.struct(F.coalesce(r["text"], F.lit("")).alias("text"), total.alias("log_prob"), n.alias("n_tokens"), (n >= most_tokens).alias("truncated"))


def step_result(body: Column) -> Column:
    """kind (``failed``, ``complete``, ``success``), next_state_id, message of an environment's answer to a step.

    An error, a parse error or ``hasSorry`` fails. No goals left is complete, with -1 for a missing
    state id. Goals without a state id and a state id without goals fail.
    """
    r = F.from_json(body, "error string, desc string, parseError string, hasSorry boolean, nextStateId long, goals array<string>")
    none, done = r["goals"].isNull(), F.size(r["goals"]) == 0
    message = (F.when(r["error"].isNotNull(), F.coalesce(r["desc"], r["error"])).when(r["parseError"].isNotNull(), r["parseError"]).when(F.coalesce(r["hasSorry"], F.lit(False)), "Proof contains sorry")
               .when(none & r["nextStateId"].isNull(), "Tactic produced no result (no goals, no stateId)").when(none, "Tactic returned stateId but no goals")
               .when(r["nextStateId"].isNull() & ~done, "Tactic failed (no next state)"))
    return F.struct(F.when(message.isNotNull(), "failed").when(done, "complete").otherwise("success").alias("kind"),
                    F.when(message.isNull(), F.coalesce(r["nextStateId"], F.lit(-1))).alias("next_state_id"), message.alias("message"))


def skipped_theorem(line: Column) -> Column:
    """theorem, error of a log line that says that a search was skipped; nulls for other lines."""
    pattern = r'Search error, skipping\s+theorem="([^"]+)"\s+error=(.*?)$'
    part = lambda i: F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))
    return F.struct(part(1).alias("theorem"), F.trim(part(2)).alias("error"))


def compiler_error(line: Column) -> Column:
    """line, message of a compiler's error; nulls for other lines."""
    part = lambda i: F.nullif(F.regexp_extract(line, r":(\d+):\d+: error: (.+)", i), F.lit(""))
    return F.struct(part(1).cast("int").alias("line"), part(2).alias("message"))


def ramp(depth: Column, start: float, end: float, over: int) -> Column:
    """From ``start`` at depth 0 to ``end`` at depth ``over`` and below; always ``start`` if that is 0."""
    return F.lit(float(start)) if over == 0 else F.lit(float(start)) + (end - start) * F.least(depth / over, F.lit(1.0))


def whole_ramp(depth: Column, start: int, end: int, over: int) -> Column:
    """As :func:`ramp`, downwards in whole numbers, what is taken off rounded down."""
    return F.lit(start).cast("long") if over == 0 else F.greatest(F.lit(start) - F.floor(max(0, start - end) * F.least(depth / over, F.lit(1.0))), F.lit(end)).cast("long")
