"""Equations of DOCX files (Office Math) as LaTeX.

Each element is written from its children; what has no form of its own is its children's text.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"

_SIGNS = {
    "∑": "\\sum", "∏": "\\prod", "∫": "\\int", "∬": "\\iint", "∮": "\\oint", "⋃": "\\bigcup", "⋂": "\\bigcap", "×": "\\times", "÷": "\\div", "±": "\\pm", "∓": "\\mp", "⋅": "\\cdot",
    "≤": "\\leq", "≥": "\\geq", "≠": "\\neq", "≈": "\\approx", "≡": "\\equiv", "∞": "\\infty", "→": "\\rightarrow", "←": "\\leftarrow", "⇒": "\\Rightarrow", "⇔": "\\Leftrightarrow", "∂": "\\partial",
    "∇": "\\nabla", "∈": "\\in", "∉": "\\notin", "⊂": "\\subset", "⊆": "\\subseteq", "∪": "\\cup", "∩": "\\cap", "∀": "\\forall", "∃": "\\exists", "∅": "\\emptyset", "¬": "\\neg", "∧": "\\wedge", "∨": "\\vee", "…": "\\dots",
    "α": "\\alpha", "β": "\\beta", "γ": "\\gamma", "δ": "\\delta", "ε": "\\varepsilon", "ζ": "\\zeta", "η": "\\eta", "θ": "\\theta", "ι": "\\iota", "κ": "\\kappa", "λ": "\\lambda", "μ": "\\mu", "ν": "\\nu", "ξ": "\\xi",
    "π": "\\pi", "ρ": "\\rho", "σ": "\\sigma", "τ": "\\tau", "υ": "\\upsilon", "φ": "\\varphi", "χ": "\\chi", "ψ": "\\psi", "ω": "\\omega", "Γ": "\\Gamma", "Δ": "\\Delta", "Θ": "\\Theta", "Λ": "\\Lambda", "Ξ": "\\Xi",
    "Π": "\\Pi", "Σ": "\\Sigma", "Φ": "\\Phi", "Ψ": "\\Psi", "Ω": "\\Omega",
}
_ESCAPED = {c: "\\" + c for c in "#$%&_{}"} | {"\\": "\\backslash ", "~": "\\sim "}
_ACCENTS = {"̂": "hat", "̃": "tilde", "̅": "bar", "̇": "dot", "̈": "ddot", "⃗": "vec", "→": "vec", "^": "hat", "~": "tilde", "¯": "bar", "˙": "dot"}
_FUNCTIONS = "sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh log ln lg exp lim max min sup inf det gcd deg dim ker arg".split()


def _text(t: str) -> str:
    return "".join(_SIGNS[c] + " " if c in _SIGNS else _ESCAPED.get(c, c) for c in t)


def _setting(node: ET.Element, name: str) -> str | None:
    """A property's value; empty if it is there without one, None if it isn't there."""
    found = node.find(f"{M}{node.tag.removeprefix(M)}Pr/{M}{name}")
    return None if found is None else found.get(f"{M}val", "")


def _all(node: ET.Element | None) -> str:
    return "".join(map(latex, node)) if node is not None else ""


def _delimited(n: ET.Element) -> str:
    left, right = _setting(n, "begChr"), _setting(n, "endChr")
    side = lambda c, usual: "." if c == "" else {"{": "\\{", "}": "\\}", "‖": "\\|", "⟨": "\\langle ", "⟩": "\\rangle "}.get(c, c) if c else usual
    return f"\\left{side(left, '(')}{', '.join(_all(e) for e in n.findall(f'{M}e'))}\\right{side(right, ')')}"


def _fraction(n: ET.Element) -> str:
    top, bottom = _all(n.find(f"{M}num")), _all(n.find(f"{M}den"))
    return {"lin": f"{top}/{bottom}", "skw": f"^{{{top}}}/_{{{bottom}}}", "noBar": f"\\binom{{{top}}}{{{bottom}}}"}.get(_setting(n, "type") or "", f"\\frac{{{top}}}{{{bottom}}}")


def _many(n: ET.Element) -> str:
    low, high = _all(n.find(f"{M}sub")), _all(n.find(f"{M}sup"))
    sign = _setting(n, "chr")
    head = "\\int" if sign is None else _text(sign).strip()
    return head + (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "") + " " + _all(n.find(f"{M}e"))


def _function(n: ET.Element) -> str:
    name = _all(n.find(f"{M}fName")).strip()
    bare = name.split("_")[0].split("^")[0]
    return (f"\\{name}" if bare in _FUNCTIONS else name if name.startswith("\\") else f"\\operatorname{{{name}}}") + " " + _all(n.find(f"{M}e"))


def _lower(n: ET.Element) -> str:
    base = _all(n.find(f"{M}e")).strip()
    return (f"\\{base}" if base in _FUNCTIONS else base) + f"_{{{_all(n.find(f'{M}lim'))}}}"


def _root(n: ET.Element) -> str:
    degree = _all(n.find(f"{M}deg"))
    return "\\sqrt" + (f"[{degree}]" if degree else "") + f"{{{_all(n.find(f'{M}e'))}}}"


def _scripts(n: ET.Element) -> str:
    base, low, high = (_all(n.find(f"{M}{k}")) for k in ("e", "sub", "sup"))
    both = (f"_{{{low}}}" if low else "") + (f"^{{{high}}}" if high else "")
    return "{}" + both + base if n.tag == f"{M}sPre" else (base if len(base) == 1 else f"{{{base}}}") + both


def _matrix(n: ET.Element) -> str:
    rows = (" & ".join(_all(e) for e in r.findall(f"{M}e")) for r in n.findall(f"{M}mr"))
    return "\\begin{matrix}" + " \\\\ ".join(rows) + "\\end{matrix}"


_FORMS = {
    "r": lambda n: _text("".join(t.text or "" for t in n.iter(f"{M}t"))), "f": _fraction, "rad": _root, "sSup": _scripts, "sSub": _scripts, "sSubSup": _scripts, "sPre": _scripts, "nary": _many,
    "d": _delimited, "func": _function, "m": _matrix, "limLow": _lower, "limUpp": lambda n: f"\\overset{{{_all(n.find(f'{M}lim'))}}}{{{_all(n.find(f'{M}e'))}}}",
    "acc": lambda n: f"\\{_ACCENTS.get(_setting(n, 'chr') or '̂', 'hat')}{{{_all(n.find(f'{M}e'))}}}",
    "bar": lambda n: ("\\overline" if _setting(n, "pos") == "top" else "\\underline") + f"{{{_all(n.find(f'{M}e'))}}}",
    "groupChr": lambda n: ("\\overbrace" if _setting(n, "pos") == "top" else "\\underbrace") + f"{{{_all(n.find(f'{M}e'))}}}",
    "eqArr": lambda n: "\\begin{array}{c}" + " \\\\ ".join(_all(e) for e in n.findall(f"{M}e")) + "\\end{array}",
}


def latex(node: ET.Element) -> str:
    """LaTeX of an element; properties have none."""
    kind = node.tag.removeprefix(M)
    if kind in _FORMS:
        return _FORMS[kind](node)
    return "" if kind.endswith("Pr") else _all(node)


def inline(node: ET.Element) -> str:
    """An equation between dollar signs; a paragraph of equations between double ones."""
    body = " ".join(latex(node).split())
    return "" if not body else f"$${body}$$" if node.tag == f"{M}oMathPara" else f"${body}$"
