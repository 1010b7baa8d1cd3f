"""Text functions over proof states and tactics, as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: families of words that mark a topic, in the order they are reported
TOPICS = {
    "number_theory": ["ℕ", "ℤ", " nat", " int", "prime", "divid", "mod ", "gcd", "lcm", "factorial", "coprime"],
    "analysis": ["continuous", "deriv", "integr", "limit", "tendsto", "measur", "filter", "nhds", "differentiable", "intervalintegral"],
    "abstract_algebra": ["polynomial", " ring", " field", " group", "subgroup", "ideal", " module", "algebra", "monoid", "commut", "isomorph", "homomorp"],
    "combinatorics": ["finset", "fintype", "card ", "choose", "permut", "subset", "powerset", "multiset"],
    "linear_algebra": ["matrix", " det", "linearmap", "basis", "eigenval", "trace", "transpose"],
    "geometry": ["polygon", "triangle", "circle", "euclidean", "dist ", "angle", "convex"],
    "series_sums": ["∑", "∏", "∑'", "tsum", "series", "sequence", "isup", "iinf"],
}
REAL_SYMBOLS = ["ℝ", "ℚ"]
#: fixed values: identifiers renamed between versions, applied in this order
RENAMES = [
    ("le_div_iff", "le_div_iff₀"), ("div_le_div_iff", "div_le_div_iff₀"), ("div_le_iff", "div_le_iff₀"),
    ("div_lt_div_iff", "div_lt_div_iff₀"), ("div_lt_iff", "div_lt_iff₀"), ("lt_div_iff", "lt_div_iff₀"),
    ("add_left_neg", "neg_add_cancel"), ("add_right_neg", "add_neg_cancel"),
    ("true_and_iff", "true_and"), ("and_true_iff", "and_true"), ("false_and_iff", "false_and"), ("and_false_iff", "and_false"),
    ("true_or_iff", "true_or"), ("or_true_iff", "or_true"), ("false_or_iff", "false_or"), ("or_false_iff", "or_false"),
]
#: fixed values: the shorter list, for whole sources
SOURCE_RENAMES = [
    ("le_div_iff", "le_div_iff₀"), ("div_le_div_iff", "div_le_div_iff₀"), ("div_le_iff", "div_le_iff₀"), ("add_left_neg", "neg_add_cancel"),
    ("add_right_neg", "add_neg_cancel"), ("true_and_iff", "true_and"), ("and_true_iff", "and_true"),
]
#: fixed values: patterns that mark tactics of the old version
OLD_PATTERNS = [
    (r"\ble_div_iff\b(?!₀)", "le_div_iff (missing ₀ suffix)"), (r"\bdiv_le_div_iff\b(?!₀)", "div_le_div_iff (missing ₀ suffix)"),
    (r"\bdiv_le_iff\b(?!₀)", "div_le_iff (missing ₀ suffix)"), (r"\badd_left_neg\b", "add_left_neg (renamed to neg_add_cancel)"),
    (r"\badd_right_neg\b", "add_right_neg (renamed to add_neg_cancel)"), (r"\btrue_and_iff\b", "true_and_iff (renamed to true_and)"),
    (r"\band_true_iff\b", "and_true_iff (renamed to and_true)"), (r"∑\s+\w+\s+in\s+", "old BigOperators notation (∑ x in S)"),
    (r"∏\s+\w+\s+in\s+", "old BigOperators notation (∏ x in S)"), (r"\bnat\.", "old Nat namespace (nat. → Nat.)"),
    (r"\bint\.", "old Int namespace (int. → Int.)"), (r"\brat\.", "old Rat namespace (rat. → Rat.)"),
    (r"\breal\.", "old Real namespace (real. → Real.)"), (r"\bcomplex\.", "old Complex namespace (complex. → Complex.)"),
    (r"\bsplit\b", "split (context: may need constructor in Lean 4)"), (r"\bexact_mod_cast\b", "exact_mod_cast (may be deprecated)"),
    (r"\bpush_cast\b", "push_cast (check compatibility)"), (r"\bnorm_cast\b", "norm_cast (check compatibility)"),
]
#: fixed values: words that end a proof without proving
GIVE_UP = ["sorry", "admit", "cheat"]
BLANKS = "[\\s\\x{85}\\x{A0}\\x{2028}\\x{2029}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANKS}+|{BLANKS}+$", "")


def tactic_head(tactic: Column) -> Column:
    """The first word of a tactic, behind a focus dot and ``<;>``; ``(root)`` for blank ones, ``(comment)`` for comments."""
    bare = strip(F.regexp_replace(strip(tactic), r"^·", ""))
    bare = strip(F.regexp_replace(bare, r"^<;>", ""))
    return F.when(tactic.isNull() | (bare == ""), "(root)").when(bare.startswith("--"), "(comment)").otherwise(F.regexp_extract(bare, r"^\S+", 0))


def count_goals(state: Column) -> Column:
    """Blocks that aren't blank, split at empty lines; 0 for null or blank states."""
    return F.when(state.isNull(), 0).otherwise(F.size(F.filter(F.split(state, "\n\n"), lambda b: strip(b) != "")))


def count_hypotheses(state: Column) -> Column:
    """Lines with a colon before the first line with a turnstile."""
    lines = F.split(state, "\n")
    before = F.when(state.contains("⊢"), F.slice(lines, 1, F.size(F.split(F.substring_index(state, "⊢", 1), "\n")) - 1)).otherwise(lines)
    return F.when(state.isNull(), 0).otherwise(F.size(F.filter(before, lambda x: x.contains(":") & (strip(x) != ""))))


def topics(state: Column) -> Column:
    """The topics whose words a state holds; ``other`` if none."""
    low = F.lower(state)
    any_of = lambda c, words: F.lit(False) if not words else _any([c.contains(w) for w in words])
    named = [F.when(any_of(low, words), name) for name, words in TOPICS.items()]
    real = F.when(any_of(state, REAL_SYMBOLS) & ~any_of(low, TOPICS["analysis"]), "real_arithmetic")
    found = F.array_compact(F.array(*named, real))
    return F.when(state.isNull() | (F.size(found) == 0), F.array(F.lit("other"))).otherwise(found)


def _any(tests):
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def contest_parts(name: Column) -> Column:
    """year, section, number of names like putnam_1988_b1; nulls for others."""
    pattern = r"(?i)^putnam_(\d{4})_([ab])(\d+)"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return F.struct(part(1).cast("int").alias("year"), F.upper(part(2)).alias("section"), part(3).cast("int").alias("number"))


def squeeze(tactic: Column) -> Column:
    """Runs of blanks become one; none at the ends."""
    return F.trim(F.regexp_replace(tactic, rf"{BLANKS}+", " "))


def gives_up(tactic: Column) -> Column:
    """Holds sorry, admit or cheat as a word of its own (ASCII letters, digits and _ are word characters)."""
    return tactic.rlike(f"(?<![A-Za-z0-9_])({'|'.join(GIVE_UP)})(?![A-Za-z0-9_])")


def gives_up_by_substring(tactic: Column, words: tuple[str, ...] = ("sorry", "admit", "cheat", "sorryAx")) -> Column:
    return _any([tactic.contains(w) for w in words])


def modernised(tactic: Column) -> Column:
    """Renamed identifiers replaced, as whole words, and the old ``∑ x in s`` by ``∑ x ∈ s``."""
    out = tactic
    for old, new in RENAMES:
        out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}_]){old}(?![\p{{L}}\p{{N}}_])", new)
    return F.regexp_replace(out, r"([∑∏]\s+\w+\s+)in(\s+)", "$1∈$2")


def lemma_names(tactic: Column) -> Column:
    """Identifiers with a dot or an upper-case start, each once, in order, joined by commas."""
    found = F.regexp_extract_all(tactic, F.lit(r"[A-Za-z_][A-Za-z0-9_'₀]*(?:\.[A-Za-z0-9_'₀]+)+|\b[A-Z][A-Za-z0-9_'₀]*"), F.lit(0))
    return F.array_join(F.array_distinct(found), ",")


def goal_parts(state: Column) -> Column:
    """hypotheses (lines before the turnstile), target (what follows it; all of a state without one)."""
    has = state.contains("⊢")
    lines = F.filter(F.transform(F.split(F.substring_index(state, "⊢", 1), "\n"), strip), lambda x: x != "")
    target = F.when(has, strip(F.substring(state, F.instr(state, "⊢") + 1, F.length(state)))).otherwise(strip(state))
    return F.struct(F.when(has, lines).otherwise(F.array().cast("array<string>")).alias("hypotheses"), target.alias("target"))


def count_turnstiles(state: Column) -> Column:
    return F.length(state) - F.length(F.replace(state, F.lit("⊢"), F.lit("")))


def prompt(state: Column) -> Column:
    """A state in the form that models are asked in."""
    return F.concat(F.lit("Complete the following Lean 4 code:\n\n```lean4\n/- tactic state:\n"), state, F.lit("\n-/\n```\n"))


def training_text(state: Column, tactic: Column) -> Column:
    return F.concat(prompt(state), tactic)


def open_prefixes(name: Column) -> Column:
    """All namespaces around a dotted name, shortest first."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")))


def shortened(text: Column, most: int) -> Column:
    """One line of at most ``most`` characters: line breaks shown as ↵, what is cut as three dots."""
    line = F.replace(text, F.lit("\n"), F.lit("↵"))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


#: fixed values: names that statements use bare, and their full names
FULL_NAMES = {
    "𝓝": "nhds", "cexp": "Complex.exp", "rexp": "Real.exp", "sqrt": "Real.sqrt", "succ": "Nat.succ", "choose": "Nat.choose", "lcm": "Nat.lcm", "natAbs": "Int.natAbs",
    "Perm": "Equiv.Perm", "Simplex": "Affine.Simplex", "dist": "Dist.dist", "esymm": "Multiset.esymm", "Prime": "_root_.Prime",
}


def qualified(statement: Column, names: dict[str, str] = FULL_NAMES) -> Column:
    """Bare names by their full ones; a name that is part of another, or behind a dot, is none."""
    for bare, full in names.items():
        statement = F.regexp_replace(statement, rf"(?U)(?<![\w.]){bare}(?!\w)", full)
    return statement


def cut_bytes(text: Column, most: int) -> Column:
    """The longest beginning of at most ``most`` bytes of UTF-8 that ends between characters."""
    b = F.encode(text, "UTF-8")
    # a character has four bytes at most: the cut goes back over bytes 0x80 to 0xBF
    inner = lambda at: F.hex(F.substring(b, at + 1, 1)).rlike("^[89AB]")
    end = F.lit(max(0, most - 3))
    for at in range(max(0, most - 2), most + 1):
        end = F.when(~inner(at), at).otherwise(end)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(b, F.lit(1), end), "UTF-8"))


def duration(seconds: Column) -> Column:
    """30s, 45m12s, 2h30m"""
    s = seconds.cast("long")
    return (F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm%02ds", F.floor(s / 60), s % 60))
            .otherwise(F.format_string("%dh%02dm", F.floor(s / 3600), F.floor((s % 3600) / 60))))


def error_class(message: Column) -> Column:
    """The class of a start-up error; the first that applies."""
    # fixed values
    tokens = ["expected token", "expected ':'", "expected ')'", "expected '|'", "expected '=>'", "expected '('", "expected ';'", "expected ':='"]
    return (F.when(message.contains("Unknown identifier"), "unknown_identifier").when(_any([message.contains(t) for t in tokens]), "parse_error")
            .when(message.contains("Tactic timed out"), "timeout").when(message.contains("SGLang request failed") | message.contains("Policy error"), "policy_error")
            .when(message.contains("Protocol error"), "protocol_error").when(message.contains("Symbol not found"), "symbol_not_found").otherwise("other"))


def without_ansi(line: Column) -> Column:
    return F.regexp_replace(line, "\\x1b\\[[0-9;]*m", "")


def broken_state(state: Column) -> Column:
    """The state speaks of an error."""
    low = F.lower(state)
    return _any([low.contains(x) for x in ("sorry", "unknown identifier", "failed to synthesize")])


def renamed_source(source: Column) -> Column:
    """A source with the names of ``SOURCE_RENAMES`` replaced, and ``in`` behind a bound sum or product as ``∈``."""
    for old, new in SOURCE_RENAMES:
        source = F.regexp_replace(source, rf"(?U)(?<!\p{{No}})\b{old}\b(?!\p{{No}})", new)
    return F.regexp_replace(source, r"(?U)([∑∏]\s+\w+)\s+in\s+", "$1 ∈ ")
