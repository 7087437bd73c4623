"""Answers as expressions: reading, and telling whether two of them mean the same.

A text becomes a tree of numbers, variables and operations, or a structure of such trees: a sequence with its brackets
(tuples, intervals), a set, a union of these, a matrix, or a bare list of answers.

Whether two trees are one polynomial or rational form is not found by rewriting them but by their values: every variable
stands for a fixed large integer, and a tree is worked out modulo several primes. Unlike forms agree there with a
probability below degree / 2^61 each time. Exponents are worked out modulo the prime less one, so powers with variables
in the exponent take part too. The values are a key: equal forms have equal keys, so answers can be grouped by it.

Forms with roots, logarithms or angles of variables are compared by their values at several real points, numbers without
variables by value, to three decimals or a thousandth of their size.
"""

from __future__ import annotations

import cmath
import hashlib
import math
import re
from fractions import Fraction
from itertools import permutations

#: Mersenne and other primes below 2^64, and the real points of a form that has no values modulo primes.
PRIMES = (2**61 - 1, 2**62 - 57, 2**63 - 25)
POINTS = 4
#: Items of a set that are matched in any order; larger sets are matched greedily.
_ANY_ORDER = 6
#: Largest exact power of a number without variables, in bits.
_BITS = 4096

# Spellings that mean the same thing.
_SAME = {
    "\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\cfrac": "\\frac", "\\cdot": "*", "\\times": "*", "\\div": "/", "\\left": "", "\\right": "",
    "\\big": "", "\\Big": "", "\\,": " ", "\\!": "", "\\;": " ", "\\:": " ", "~": " ", "$": "", "²": "^2", "³": "^3", "√": "\\sqrt",
    "π": "\\pi", "∞": "\\infty", "∪": "\\cup", "·": "*", "×": "*", "−": "-", "\\lbrace": "\\{", "\\rbrace": "\\}", "**": "^",
    "^\\circ": "", "^{\\circ}": "", "°": "", "\\%": "%", "\\quad": " ", "\\mathrm": "\\text", "\\operatorname": "\\text", "\\mbox": "\\text",
}
_TOKEN = re.compile(r"\s*(\d+(?:\.\d+)?|\.\d+|\\text\{[^{}]*\}|\\begin\{\w+\}|\\end\{\w+\}|\\\\|\\[{}|]|\\[a-zA-Z]+|sqrt|pi|inf|[a-zA-Z]|[-+*/^!(){}\[\],%|&;=<>_])")
_FUNCTIONS = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "exp": cmath.exp, "ln": cmath.log, "log": cmath.log10, "arctan": cmath.atan,
    "arcsin": cmath.asin, "arccos": cmath.acos, "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh,
}
_GREEK = {"alpha", "beta", "gamma", "delta", "theta", "lambda", "mu", "phi", "varphi", "omega", "rho", "sigma", "tau", "epsilon"}
_OPEN, _CLOSE = {"(": ")", "[": "]"}, {")", "]"}


class Unread(ValueError):
    """A text outside the grammar."""


class NotExact(ValueError):
    """A form without values modulo primes."""


# --- reading ----------------------------------------------------------------------------------


class _Reader:
    def __init__(self, text: str):
        for a, b in _SAME.items():
            text = text.replace(a, b)
        text = re.sub(r"(?<!\\)\\ ", " ", text)  # a blank, not the end of a matrix row
        text = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text)
        text = re.sub(r"(?<=\d)\s+(?=\d+\s*/\s*\d)", "+", text)  # 7 3/4
        text = re.sub(r"^\s*[a-zA-Z](?:_\w|_\{\w+\})?\s*=(?!=)", "", text).strip().rstrip(".")
        self.toks, pos = [], 0
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise Unread(text)
            self.toks.append(m.group(1))
            pos = m.end()
        # words behind an expression are a unit
        while len(self.toks) > 1 and self.toks[-1].startswith("\\text"):
            self.toks.pop()
        self.i = 0

    def peek(self) -> str:
        return self.toks[self.i] if self.i < len(self.toks) else ""

    def take(self, want: str = "") -> str:
        tok = self.peek()
        if not tok or (want and tok != want):
            raise Unread(tok)
        self.i += 1
        return tok

    def answer(self):
        items = [self.union()]
        while self.peek() in (",", ";"):
            self.take()
            items.append(self.union())
        if self.peek():
            raise Unread(self.peek())
        return items[0] if len(items) == 1 else ("list", items)

    def union(self):
        parts = [self.item()]
        while self.peek() == "\\cup":
            self.take()
            parts.append(self.item())
        return parts[0] if len(parts) == 1 else ("union", parts)

    def item(self):
        if self.peek() == "\\{":
            return ("set", self.between("\\{", ("\\}",))[0])
        if self.peek() in _OPEN and (found := self.sequence()):
            return found
        return self.sum()

    def between(self, opening: str, closing: tuple[str, ...]):
        self.take(opening)
        items = []
        if self.peek() not in closing:
            items.append(self.union())
            while self.peek() in (",", ";"):
                self.take()
                items.append(self.union())
        if self.peek() not in closing:
            raise Unread(self.peek())
        return items, self.take()

    def sequence(self):
        """A bracketed list of two or more, or None (and nothing taken) if the bracket is only a factor."""
        at, opening = self.i, self.peek()
        try:
            items, closing = self.between(opening, tuple(_CLOSE))
        except Unread:
            items, closing = [], ""
        if len(items) > 1 and self.peek() in ("", ",", ";", "\\cup", *_CLOSE, "\\}"):
            return ("seq", opening, items, closing)
        self.i = at
        return None

    def sum(self):
        sign = 1
        while self.peek() in ("+", "-"):
            sign = -sign if self.take() == "-" else sign
        value = self.product()
        value = value if sign > 0 else ("*", ("num", Fraction(-1)), value)
        while self.peek() in ("+", "-"):
            minus, term = self.take() == "-", self.product()
            value = ("+", value, ("*", ("num", Fraction(-1)), term) if minus else term)
        return value

    def product(self):
        value = self.power()
        while (tok := self.peek()) and tok not in ("+", "-", ",", ";", ")", "}", "]", "\\}", "\\cup", "&", "\\\\", "=", "<", ">", "|") and not tok.startswith("\\end"):
            if tok == "/":
                self.take()
                value = ("/", value, self.power())
            elif tok == "%":
                self.take()
                value = ("/", value, ("num", Fraction(100)))
            else:
                if tok == "*":
                    self.take()
                value = ("*", value, self.power())
        return value

    def power(self):
        if self.peek() in ("-", "+"):
            minus, value = self.take() == "-", self.power()
            return ("*", ("num", Fraction(-1)), value) if minus else value
        base = self.atom()
        while self.peek() == "!":
            self.take()
            base = ("!", base)
        if self.peek() == "^":
            self.take()
            base = ("^", base, self.group() if self.peek() in ("{",) else self.power())
        return base

    def group(self):
        if self.peek() != "{":
            tok = self.peek()  # \frac12 takes single digits
            if tok.isdigit() and len(tok) > 1:
                self.toks[self.i : self.i + 1] = list(tok)
            return self.atom()
        self.take("{")
        value = self.sum()
        self.take("}")
        return value

    def atom(self):
        tok = self.take()
        if tok[0].isdigit() or tok[0] == ".":
            whole = ("num", Fraction(tok))
            if tok.isdigit() and self.peek() == "\\frac":  # a mixed number
                at = self.i
                part = self.atom()
                if all(p[0] == "num" and p[1].denominator == 1 for p in part[1:]) and 0 < part[1][1] < part[2][1]:
                    return ("+", whole, part)
                self.i = at
            return whole
        if tok in ("(", "[", "{"):
            value = self.sum()
            self.take({"(": ")", "[": "]", "{": "}"}[tok])
            return value
        if tok == "|":
            value = self.sum()
            self.take("|")
            return ("fn", "abs", value)
        if tok == "\\frac":
            top = self.group()
            return ("/", top, self.group())
        if tok == "\\binom":
            top = self.group()
            return ("binom", top, self.group())
        if tok in ("\\sqrt", "sqrt"):
            root = ("num", Fraction(2))
            if self.peek() == "[":
                self.take()
                root = self.sum()
                self.take("]")
            return ("root", root, self.group())
        if tok in ("\\pi", "pi"):
            return ("pi",)
        if tok in ("\\infty", "inf"):
            return ("inf",)
        if tok.startswith("\\begin"):
            return self.matrix(tok[7:-1])
        if tok.startswith("\\text"):
            return ("text", " ".join(tok[6:-1].lower().split()))
        name = tok[1:] if tok[0] == "\\" else tok
        if tok[0] == "\\" and name in _FUNCTIONS:
            times = None
            if self.peek() == "^":
                self.take()
                times = self.group()
            inner = self.argument()
            return ("fn", name, inner) if times is None else ("^", ("fn", name, inner), times)
        if tok[0] == "\\" and name not in _GREEK or not name.isalpha():
            raise Unread(tok)
        if self.peek() == "_":
            self.take()
            index = self.take() if self.peek() != "{" else self.take("{") and self.take()
            if self.peek() == "}" and self.toks[self.i - 2] == "{":
                self.take("}")
            name = f"{name}_{index}"
        return ("var", name)

    def argument(self):
        """What a function without brackets applies to: the factors up to a sign, a quotient or another function."""
        value = self.power()
        bracketed = self.toks[self.i - 1] in (")", "}")
        while not bracketed and (tok := self.peek()) and (tok[0].isalnum() or tok in ("\\pi", "\\frac", "\\sqrt", "pi")):
            value = ("*", value, self.power())
        return value

    def matrix(self, kind: str):
        rows = [[]]
        while True:
            rows[-1].append(self.sum())
            tok = self.take()
            if tok == "\\\\":
                if self.peek().startswith("\\end"):
                    self.take()
                    break
                rows.append([])
            elif tok.startswith("\\end"):
                break
            elif tok != "&":
                raise Unread(tok)
        if "matrix" not in kind or len({len(r) for r in rows}) != 1:
            raise Unread(kind)
        return ("matrix", rows)


def read(text: str):
    """The tree of an answer; raises Unread."""
    try:
        return _Reader(text).answer()
    except RecursionError as e:
        raise Unread("too deep") from e


# --- values -----------------------------------------------------------------------------------


def _integer(name: str) -> int:
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:15], "big") + 2


def modular(tree, p: int) -> int:
    """The value modulo a prime; raises NotExact, or ZeroDivisionError at a pole."""
    kind = tree[0]
    if kind == "num":
        return tree[1].numerator * pow(tree[1].denominator, -1, p) % p
    if kind == "var":
        return _integer(tree[1]) % p
    if kind in ("pi", "inf"):  # symbols without relations to others
        return _integer(kind) % p
    if kind == "+":
        return (modular(tree[1], p) + modular(tree[2], p)) % p
    if kind == "*":
        return modular(tree[1], p) * modular(tree[2], p) % p
    if kind == "/":
        below = modular(tree[2], p)
        if not below:
            raise ZeroDivisionError
        return modular(tree[1], p) * pow(below, -1, p) % p
    if kind == "^":
        base = modular(tree[1], p)
        times = _exponent(tree[2], p - 1)
        if not base and times:
            return 0
        return pow(base, times, p)
    if kind in ("!", "binom", "root"):
        value = _rational(tree)
        return value.numerator * pow(value.denominator, -1, p) % p
    raise NotExact(kind)


def _exponent(tree, m: int) -> int:
    kind = tree[0]
    if kind == "num" and tree[1].denominator == 1:
        return tree[1].numerator % m
    if kind == "var":
        return _integer(tree[1]) % m
    if kind == "+":
        return (_exponent(tree[1], m) + _exponent(tree[2], m)) % m
    if kind == "*":
        return _exponent(tree[1], m) * _exponent(tree[2], m) % m
    value = _rational(tree)
    if value.denominator != 1:
        raise NotExact(kind)
    return value.numerator % m


def _rational(tree) -> Fraction:
    """The exact value of a tree without variables; raises NotExact."""
    kind = tree[0]
    if kind == "num":
        return tree[1]
    if kind in ("+", "*", "/", "^", "binom"):
        a, b = _rational(tree[1]), _rational(tree[2])
        if kind == "+":
            return a + b
        if kind == "*":
            return a * b
        if kind == "/":
            return a / b
        if kind == "binom":
            if a.denominator == b.denominator == 1 and 0 <= b <= a <= 4096:
                return Fraction(math.comb(int(a), int(b)))
            raise NotExact(kind)
        if b.denominator == 1 and abs(b) * max(a.numerator.bit_length(), a.denominator.bit_length(), 1) <= _BITS:
            return a ** int(b)
        raise NotExact(kind)
    if kind == "!":
        a = _rational(tree[1])
        if a.denominator == 1 and 0 <= a <= 400:
            return Fraction(math.factorial(int(a)))
        raise NotExact(kind)
    if kind == "root":
        n, a = _rational(tree[1]), _rational(tree[2])
        if n == 2 and a >= 0:
            top, below = math.isqrt(a.numerator), math.isqrt(a.denominator)
            if top * top == a.numerator and below * below == a.denominator:
                return Fraction(top, below)
    raise NotExact(kind)


def real(tree, point: int = 0) -> complex:
    """The value at a point, a variable's coordinate following from its name."""
    kind = tree[0]
    if kind == "num":
        return complex(tree[1])
    if kind == "var":
        if tree[1] == "e":
            return complex(math.e)
        if tree[1] == "i":
            return 1j
        drawn = _integer(f"{tree[1]}:{point}")
        return complex((1 if drawn >> 40 & 1 else -1) * (1 + drawn % 1_000_003 / 1_000_003))
    if kind == "pi":
        return complex(math.pi)
    if kind == "inf":
        return complex(math.inf)
    if kind == "+":
        return real(tree[1], point) + real(tree[2], point)
    if kind == "*":
        return real(tree[1], point) * real(tree[2], point)
    if kind == "/":
        return real(tree[1], point) / real(tree[2], point)
    if kind == "^":
        return real(tree[1], point) ** real(tree[2], point)
    if kind == "root":
        n, a = real(tree[1], point), real(tree[2], point)
        # an odd root of a negative number is the real one
        return -((-a) ** (1 / n)) if a.imag == 0 > a.real and n.real % 2 == 1 else a ** (1 / n)
    if kind == "fn":
        return complex(abs(real(tree[2], point))) if tree[1] == "abs" else _FUNCTIONS[tree[1]](real(tree[2], point))
    return complex(_rational(tree))


def _symbols(tree) -> frozenset[str]:
    """Variables, and ``inf``."""
    if tree[0] == "var":
        return frozenset() if tree[1] in ("e", "i") else frozenset((tree[1],))
    if tree[0] == "inf":
        return frozenset(("inf",))
    return frozenset().union(*(_symbols(t) for t in tree[1:] if isinstance(t, tuple)))


def key(tree) -> str | None:
    """Equal for all spellings of one exact form, and for structures of such; None if there is none."""
    kind = tree[0]
    try:
        if kind in ("list", "set", "union"):
            inner = [key(t) for t in tree[1]]
            return None if None in inner else f"{kind}{{{','.join(sorted(set(inner)) if kind != 'list' else sorted(inner))}}}"
        if kind == "seq":
            inner = [key(t) for t in tree[2]]
            return None if None in inner else f"{tree[1]}{','.join(inner)}{tree[3]}"
        if kind == "matrix":
            inner = [[key(t) for t in row] for row in tree[1]]
            return None if any(None in row for row in inner) else "|".join(",".join(row) for row in inner)
        if kind == "text":
            return f"text:{tree[1]}"
        return ":".join(f"{modular(tree, p):x}" for p in PRIMES)
    except (NotExact, ZeroDivisionError, OverflowError, RecursionError, ValueError):
        return None


# --- comparing --------------------------------------------------------------------------------


def _near(a: complex, b: complex) -> bool:
    if a == b:
        return True
    if not (cmath.isfinite(a) and cmath.isfinite(b)):
        return False
    if abs(a.imag) < 1e-12 and abs(b.imag) < 1e-12 and round(a.real, 3) == round(b.real, 3):
        return True
    return abs(a - b) / max(abs(a), abs(b), 1e-12) < 1e-3


def _literal(tree) -> tuple[str, Fraction | None]:
    """How a number is written: ``int``, ``frac`` (a quotient of two integers) or ``other``."""
    minus = 1
    while tree[0] == "*" and tree[1] == ("num", Fraction(-1)):
        minus, tree = -minus, tree[2]
    if tree[0] == "num":
        return ("int", minus * tree[1]) if tree[1].denominator == 1 else ("other", None)
    if tree[0] == "/" and all(t[0] == "num" and t[1].denominator == 1 for t in tree[1:]):
        return ("frac", None)
    return ("other", None)


def same_value(a, b, strict: bool) -> bool:
    """Two trees that are no structures. ``strict``: an integer is matched by an integer, a quotient only by the like quotient."""
    if "text" in (a[0], b[0]):
        return a == b
    if strict:
        kinds = _literal(a)[0], _literal(b)[0]
        if kinds == ("frac", "frac"):
            return a == b
        if "int" in kinds and kinds != ("int", "int"):
            return False
    names = _symbols(a) | _symbols(b)
    if not names:
        try:
            if _rational(a) == _rational(b):
                return True
        except (NotExact, ZeroDivisionError, OverflowError):
            pass
        return _near(real(a), real(b))
    one, two = key(a), key(b)
    if one is not None and two is not None or "inf" in names:
        return one == two
    for point in range(POINTS):
        x, y = real(a, point), real(b, point)
        if not (cmath.isfinite(x) and cmath.isfinite(y)) or abs(x - y) > 1e-9 * max(abs(x), abs(y), 1e-9):
            return False
    return True


def _matched(a: list, b: list, strict: bool, order: bool) -> bool:
    if order:
        return len(a) == len(b) and all(same(x, y, strict) for x, y in zip(a, b))
    if not (all(any(same(x, y, strict) for y in b) for x in a) and all(any(same(x, y, strict) for x in a) for y in b)):
        return False
    if len(a) != len(b):
        return False
    if len(a) <= _ANY_ORDER:
        table = [[same(x, y, strict) for y in b] for x in a]
        return any(all(table[i][j] for i, j in enumerate(way)) for way in permutations(range(len(b))))
    left = list(b)
    for x in a:
        at = next((i for i, y in enumerate(left) if same(x, y, strict)), None)
        if at is None:
            return False
        del left[at]
    return True


def same(a, b, strict: bool = False) -> bool:
    """Whether two trees mean the same; structures are compared part by part, sets and lists in any order."""
    structures = {"list", "set", "union", "seq", "matrix"}
    if a[0] in structures or b[0] in structures:
        if {a[0], b[0]} == {"list", "set"}:  # {1, 2} and 1, 2
            return _matched(a[1], b[1], strict, False)
        if a[0] != b[0]:
            return a[0] == "set" and len(a[1]) == 1 and same(a[1][0], b, strict) or b[0] == "set" and len(b[1]) == 1 and same(a, b[1][0], strict)
        if a[0] == "seq":
            return a[1] == b[1] and a[3] == b[3] and _matched(a[2], b[2], strict, True)
        if a[0] == "matrix":
            return len(a[1]) == len(b[1]) and all(_matched(x, y, strict, True) for x, y in zip(a[1], b[1]))
        return _matched(a[1], b[1], strict, False)
    return same_value(a, b, strict)


def equal(gold: str | None, found: str | None, strict: bool = False) -> bool | None:
    """True or False, or None when one side is outside the grammar. ``\\pm`` in ``found`` stands for either sign, or both."""
    if not gold or not found:
        return False
    if gold.strip() == found.strip():
        return True
    forms = [found]
    if "\\pm" in found:
        both = [found.replace("\\pm", "+"), found.replace("\\pm", "-")]
        forms = [*both, ", ".join(both)]
    try:
        want = read(gold)
    except Unread:
        return None
    seen = False
    for form in forms:
        try:
            if same(want, read(form), strict):
                return True
            seen = True
        except (Unread, NotExact, ZeroDivisionError, OverflowError, RecursionError, ValueError):
            continue
    return False if seen else None


def answer_key(text: str | None) -> str | None:
    """``key`` of a text; None if it cannot be read or has no exact form."""
    if not text:
        return None
    try:
        return key(read(text))
    except Unread:
        return None
