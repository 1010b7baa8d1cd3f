"""Proof texts: steps, comments, statements, logs and answers."""
import pytest
from pyspark.sql import functions as F

from cairn.functions import proofs as P


@pytest.mark.parametrize("text,want", [
    ("  simp  ", "simp"), ("", ""), ("  \n  ", ""), ("·\nintro h", "intro h"), ("· intro h\nexact h", "intro h"), ("/- why -/\nomega", "omega"),
    ("simp_all [a,\n  b]", "simp_all [a,\nb]"), (" have h := by\n     exact foo\n   ring", "have h := by\nexact foo"),
    ("```lean4\nintro h\nexact h\n```", "intro h"), ("simp [a, b]\nexact h", "simp [a, b]"), ("rw [show a = c from\n  by ring]", "rw [show a = c from\nby ring]"),
])
def test_first_step(text, want):
    assert P.first_step(text) == want


@pytest.mark.parametrize("text,want", [
    ("intro h\nexact h", ["intro h", "exact h"]),
    ("  intro h\n  have k := by\n    nlinarith\n  exact k", ["intro h", "have k := by nlinarith", "exact k"]),
    ("  calc x + y\n    = y + x := by ring\n  _ = z := by simp", ["calc x + y\n= y + x := by ring\n_ = z := by simp"]),
    ("  conv =>\n    rw [foo]\n  simp", ["conv =>\n  rw [foo]", "simp"]),
    ("  match h with\n  | inl a => exact a\n  | inr b => exact b", ["match h with\n  | inl a => exact a\n  | inr b => exact b"]),
    ("```lean4\n-- a\nintro h\nring\n```\nmore", ["intro h", "ring"]),
    ("theorem foo : True := by\n  trivial", ["trivial"]), ("theorem foo : True := by", []), ("", []), ("  \n ", []),
    ("have h : P := by\n  intro x\n  exact x\nexact h", ["have h : P", "intro x", "exact x", "exact h"]),
    ("  have h := by\n    rw [foo]\n    simp\n  exact h", ["have h := by\n  rw [foo]\n  simp", "exact h"]),
    ("    have a : u = 34 := by\n      have b : 34 ∈ S := by\n        rw [h]\n        norm_num\n      exact c\n    simp", ["have a : u = 34", "have b : 34 ∈ S := by\n  rw [h]\n  norm_num", "exact c", "simp"]),
    ("interval_cases x\n<;> omega\n<;>\nsimp", ["interval_cases x <;> omega", "simp"]), ("·\nintro h\n·\nexact h", ["intro h", "exact h"]),
    ("  rcases b with (_ | _) <;>\n  simp_all [p] <;>\n  norm_num at * <;>\n  linarith", ["rcases b with (_ | _) <;> simp_all [p] <;> norm_num at * <;> linarith"]),
    ("simp [h]\n<;> ring_nf\n<;> norm_num\nexact k", ["simp [h] <;> ring_nf <;> norm_num", "exact k"]),
    ("simp <;>\n\nexact h", ["simp", "exact h"]), ("· simp\n∙ ring", ["simp", "ring"]),
])
def test_steps(text, want):
    assert P.steps(text) == want


@pytest.mark.parametrize("head,want", [
    ("have h : T := by", "have h : T"), ("let x : Nat := by", "let x : Nat"), ("have h : T by", "have h : T"), ("have h := by", None), ("conv => by", None), ("have h : T := foo", None),
])
def test_stated_goal(head, want):
    assert P.stated_goal(head) == want


def test_flat_steps():
    assert P.flat_steps("```lean4\ntheorem t : P := by\n  intro x\n  exact x\n```") == ["intro x", "exact x"]
    assert P.flat_steps("theorem foo : True := by trivial") == ["trivial"] and P.flat_steps("theorem foo : True := by") == []


def test_sources():
    source = "/- a /- nested -/ sorry -/\ntheorem t : P := by -- sorry\n  simp\n  admit\n"
    assert P.uncommented(source).split("\n") == ["", "theorem t : P := by ", "  simp", "  admit", ""]
    assert P.uncommented("a -/ b") == "a -/ b" and P.uncommented("a\n/- b\nc") == "a\n\n"
    got = P.integrity(source)
    assert got == {"contaminated": True, "reasons": ["admit in tactic: admit"], "suspicious": [], "trivial": False, "tactic_count": 2}
    assert P.integrity("theorem t : P := by rfl;")["trivial"]
    assert P.top_steps("  rw [a]\n    b\n  -- c\n  /- d\n e -/\n  simp") == ["rw [a]\nb", "simp"]
    assert P.proof_heads("theorem t := by\n  simp [a,\n   b] <;> x\n  · (ring) <;> omega\n") == ["simp", "ring", "omega"]


def test_statements():
    assert P.as_expression("(x : Nat) (h : x > 0) : x ≥ 1") == "∀ (x : Nat) (h : x > 0), x ≥ 1"
    assert P.as_expression(": ∃ a b : ℕ, a = b") == "∃ a b : ℕ, a = b"
    assert P.as_expression("(x : T) : ∃ y : T,  y = x") == "∀ (x : T), ∃ y : T, y = x"
    assert P.binder_names("(a b : ℝ) {c : ℕ} [inst : Fintype α] (h₀ : a = b) (x)") == ["a", "b", "c", "inst", "h₀"]
    assert P.declarations("theorem a (x : N) : x = x := by sorry\ntheorem b : P := sorry") == [{"name": "a", "statement": "∀ (x : N), x = x"}, {"name": "b", "statement": "P"}]
    assert P.state_as_statement("a : N\nh : a = 1\nthing\n⊢ a\n  = 2") == "∀ (a : N) (h : a = 1), a = 2" and P.state_as_statement("x") is None
    two = "head\n-- proof 1\ntheorem t (a : N) : a = a := by\n  rfl\n-- proof 2\ntheorem u : P := by\n  sorry\n"
    assert [(p["proof_id"], p["theorem"], p["names"], p["goal"], p["proof"].strip()) for p in P.proofs_of(two)] == [("1", "t", ["a"], "a = a", "rfl")]


def test_columns(spark):
    df = spark.createDataFrame([("have h : P := by\n  simp\n  ring",), (None,), ("",)], "t string")
    got = df.select(P.steps_of(df.t).alias("s"), P.first_step_of(df.t).alias("f"), P.integrity_of(df.t).alias("i"), P.declarations_of(df.t).alias("d")).collect()
    assert [r.s for r in got] == [["have h : P", "simp", "ring"], None, []] and got[1].f is None and got[0].i.tactic_count == 2 and got[2].d == []


def test_qualified(spark):
    from cairn.functions import text

    pairs = [("∑ k ∈ s, choose n k = sqrt 2", "∑ k ∈ s, Nat.choose n k = Real.sqrt 2"), ("Real.sqrt x", "Real.sqrt x"), ("sqrt2 + my_sqrt", "sqrt2 + my_sqrt"), ("Tendsto f (𝓝 0)", "Tendsto f (nhds 0)"), (None, None)]
    got = spark.createDataFrame([(a,) for a, _ in pairs], "t string").select(text.qualified(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [b for _, b in pairs]


def test_definitions_and_open_theorems():
    source = "import M\n/- note\nabbrev no_solution : N := sorry -/\nnoncomputable abbrev a_solution :\n  Set N := sorry -- {1}\n\ndef two (x : N) : N :=\n  x + x\n\nnoncomputable def r : R := 1\ndef b_solution := 3\ntheorem t (x : N)\n  : x = two x := by\n  sorry\n"
    assert P.definitions(source) == ["noncomputable abbrev a_solution : Set N := sorry", "def two (x : N) : N :=\n  x + x", "noncomputable def r : R := 1"]
    assert P.declarations("theorem a : (let y := 1; y = 1) := sorry\ntheorem b (x : N) : x = x := by\n  sorry\ntheorem c : P := by rfl\ntheorem") == [{"name": "a", "statement": "(let y := 1; y = 1)"}, {"name": "b", "statement": "∀ (x : N), x = x"}]
    assert P.definitions("") == [] and P.declarations("") == []
