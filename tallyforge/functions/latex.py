"""Plain text of content with LaTeX: a scanner for commands and groups, and a printer that descends into arguments."""

from __future__ import annotations

import re

#: Commands that stand for one character.
SYMBOLS = {
    "therefore": "∴", "because": "∵", "angle": "∠", "parallel": "∥", "perp": "⊥", "triangle": "△", "odot": "⊙", "degree": "°", "circ": "°",
    "times": "×", "div": "÷", "ldots": "…", "dots": "…", "cdots": "⋯", "cdot": "·", "leqslant": "≤", "leq": "≤", "le": "≤", "geqslant": "≥", "geq": "≥", "ge": "≥",
    "nRightarrow": "⇏", "Longleftrightarrow": "⇔", "Leftrightarrow": "⇔", "Longrightarrow": "⇒", "Longleftarrow": "⇐", "Leftarrow": "⇐", "Rightarrow": "⇒",
    "Downarrow": "⇓", "Uparrow": "⇑", "Updownarrow": "⇕", "rightarrow": "→", "leftarrow": "←", "leftrightarrow": "↔", "downarrow": "↓", "uparrow": "↑", "updownarrow": "↕", "to": "→",
    "forall": "∀", "exists": "∃", "neg": "¬", "epsilon": "ε", "varepsilon": "ε", "neq": "≠", "ne": "≠", "lt": "<", "gt": ">", "approx": "≈", "cong": "≌", "equiv": "≡", "sim": "∼",
    "pm": "±", "mp": "∓", "mid": "|", "notin": "∉", "infty": "∞", "in": "∈", "emptyset": "∅", "varnothing": "∅",
    "subsetneqq": "⫋", "subsetneq": "⊊", "subseteq": "⊆", "subset": "⊂", "supsetneqq": "⫌", "supsetneq": "⊋", "supseteq": "⊇", "supset": "⊃", "cup": "∪", "cap": "∩",
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "varphi": "φ", "phi": "φ", "theta": "θ", "lambda": "λ", "mu": "μ", "omega": "ω", "Omega": "Ω", "Delta": "△", "pi": "π", "complement": "∁",
    "qquad": " ", "quad": " ",
}
#: The scripts' characters and the letters of number sets.
SUPERSCRIPTS = str.maketrans("0123456789+-/abcdefghijklmnoprstuvwxyz", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁄ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖʳˢᵗᵘᵛʷˣʸᶻ")
SUBSCRIPTS = str.maketrans("0123456789aehijklmnoprstuvx", "₀₁₂₃₄₅₆₇₈₉ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ")
BOARD = {"C": "ℂ", "H": "ℍ", "N": "ℕ", "P": "ℙ", "Q": "ℚ", "R": "ℝ", "Z": "ℤ"}
FUNCTIONS = ("sin", "cos", "tan", "cot", "log", "lg", "ln", "max", "min")
#: Layout environments that leave no mark.
LAYOUTS = ("aligned", "array", "matrix", "pmatrix", "bmatrix", "vmatrix")

_LETTERS, _WORD, _LETTER = re.compile("[A-Za-z]+"), re.compile("[A-Za-z0-9]+"), re.compile("[A-Za-z]")
#: What a command writes around its argument, and what it takes where no group follows.
_AROUND = {
    "operatorname": ("", "", None), "text": ("", "", _LETTERS), "mathrm": ("", "", _LETTERS), "rm": ("", "", _LETTERS), "boldsymbol": ("", "", _LETTER), "mathbf": ("", "", _LETTER), "mathit": ("", "", _LETTER),
    "overline": ("", "", None), "bar": ("", "", _WORD), "widehat": ("⌒", "", None), "hat": ("", "̂", _WORD), "vec": ("→", "", _WORD),
    "overrightarrow": ("→", "", None), "overleftarrow": ("←", "", None), "overleftrightarrow": ("↔", "", None),
}
_OTHERS = ("begin", "end", "left", "right", "frac", "dfrac", "tfrac", "sqrt", "underline", "mathbb", "not")
_NAMES = sorted({*SYMBOLS, *FUNCTIONS, *_AROUND, *_OTHERS}, key=len, reverse=True)
_SCRIPT = re.compile(r"[0-9A-Za-z+*/-]+")
_BARE_FRACTION = re.compile(r"([A-Za-z0-9]+)√(\d+)(\d)|√([A-Za-z0-9])([A-Za-z0-9]+)|(-?\d)(\d+)|([A-Za-z])(\d+)")


class _Printer:
    """Prints a text from left to right; arguments are printed by a printer of their own."""

    def __init__(self, source: str):
        self.source, self.at, self.out = source, 0, ""

    def run(self) -> str:
        while self.at < len(self.source):
            ch = self.source[self.at]
            step = {"\\": self.command, "&": self.column, "^": self.raised, "_": self.lowered}.get(ch)
            if step is None or not step():
                self.out += ch
                self.at += 1
        return self.out

    # reading

    def blanks(self) -> None:
        while self.source[self.at : self.at + 1].isspace():
            self.at += 1

    def taken(self, mark: str) -> bool:
        found = self.source.startswith(mark, self.at)
        self.at += len(mark) * found
        return found

    def enclosed(self, opening: str = "{", closing: str = "}") -> str | None:
        """The source of a group here, read over; None where none is closed."""
        if not self.source.startswith(opening, self.at):
            return None
        depth, end = 0, self.at
        while end < len(self.source):
            if self.source[end] == "\\":
                end += 2
                continue
            depth += (self.source[end] == opening) - (self.source[end] == closing)
            end += 1
            if depth == 0:
                inner, self.at = self.source[self.at + 1 : end - 1], end
                return inner
        return None

    def matched(self, pattern: re.Pattern) -> str | None:
        found = pattern.match(self.source, self.at)
        if found is None:
            return None
        self.at = found.end()
        return found[0]

    def argument(self, bare: re.Pattern | None) -> str | None:
        """The printed argument: a group, or else a bare stretch."""
        start = self.at
        if bare is not None:
            self.blanks()
        inner = self.enclosed()
        if inner is None and bare is not None:
            inner = self.matched(bare)
        if inner is None:
            self.at = start
            return None
        return _Printer(inner).run()

    # printing

    def command(self) -> bool:
        start = self.at
        if self.taken("\\\\"):
            if _LETTER.match(self.source, self.at):
                self.at -= 1
                return self.command()
            # a line break within its white space
            self.out = self.out.rstrip() + "； "
            self.blanks()
            return True
        self.at += 1
        letters = _LETTERS.match(self.source, self.at)
        if letters is None:
            return self.escaped()
        name = next((n for n in _NAMES if letters[0].startswith(n) and (n not in FUNCTIONS or n == letters[0])), None)
        if name is None:
            if len(letters[0]) == 1:
                return True
            self.at = start
            return False
        self.at += len(name)
        if self.named(name):
            return True
        self.at = start
        return False

    def escaped(self) -> bool:
        ch = self.source[self.at : self.at + 1]
        if ch and ch in ",;:!":
            self.at += 1
        elif ch and ch in "{}()[]|.-%":
            self.out += ch
            self.at += 1
        elif ch and not ch.isspace():
            self.at -= 1
            return False
        return True

    def named(self, name: str) -> bool:
        if name in _AROUND:
            before, after, bare = _AROUND[name]
            inner = self.argument(bare)
            if inner is None:
                return False
            self.out += before + inner + after
        elif name in ("left", "right"):
            return self.delimiter("{ " if name == "left" else " }")
        elif name in ("begin", "end"):
            return self.environment("{ " if name == "begin" else " }")
        elif name.endswith("frac"):
            return self.fraction(name)
        elif name == "sqrt":
            return self.root()
        elif name == "underline":
            self.enclosed()
            self.out += "____"
        elif name == "mathbb":
            self.taken("{")
            letter = self.matched(_LETTER)
            if letter is None:
                return False
            self.taken("}")
            self.out += BOARD.get(letter.upper(), letter)
        elif name == "not":
            if not self.taken("\\Rightarrow"):
                return False
            self.out += "⇏"
        else:
            self.out += SYMBOLS.get(name, name)
            if name in ("triangle", "odot"):
                self.blanks()
        return True

    def delimiter(self, brace: str) -> bool:
        self.blanks()
        if self.taken("\\"):
            ch = self.source[self.at : self.at + 1]
            if ch and ch in "{}()[]|":
                self.out += ch
                self.at += 1
            else:
                self.out += brace
                self.blanks()
            return True
        ch = self.source[self.at : self.at + 1]
        if not ch or ch not in ".()[]{}|":
            return False
        self.out += "" if ch == "." else ch
        self.at += 1
        return True

    def environment(self, brace: str) -> bool:
        name = self.enclosed() or ("cases" if self.taken("cases") else "")
        if name == "cases":
            self.out += brace
        elif name in LAYOUTS:
            if brace == "{ ":
                self.enclosed()
        else:
            return False
        return True

    def fraction(self, name: str) -> bool:
        above = self.argument(None)
        if above is not None:
            below = self.argument(None)
            if below is None:
                return False
            self.out += f"{_part(above)}/{_part(below)}"
            return True
        rest = _Printer(self.source[self.at :]).run() if self.source.startswith("\\sqrt", self.at) else self.source[self.at :]
        found = _BARE_FRACTION.match(rest) if name == "frac" else None
        if found is None:
            return False
        a, b, c, d, e, *plain = found.groups()
        parts = [x for x in plain if x is not None]
        self.out += f"{a}√{b}/{c}" if a else f"√{d}/{e}" if d else "/".join(parts)
        self.source, self.at = rest, found.end()
        return True

    def root(self) -> bool:
        index = self.enclosed("[", "]")
        body = self.argument(None)
        if body is None:
            body = self.matched(_WORD)
        if body is None:
            return False
        sign = "√" if index is None else "∛" if index == "3" else f"{index}√" if index.isdigit() else f"{index.translate(SUPERSCRIPTS)}√"
        self.out += sign + body
        return True

    def column(self) -> bool:
        self.out = self.out.rstrip() + "，"
        self.at += 1
        self.blanks()
        return True

    def script(self, table: dict, bare: re.Pattern, round_too: bool) -> bool:
        """A script after its base; what has no characters for it stays as written."""
        start = self.at
        self.at += 1
        inner = self.enclosed()
        if inner is None and round_too:
            inner = self.enclosed("(", ")")
        text = self.matched(bare) if inner is None else _Printer(inner).run()
        if text is None or not _SCRIPT.fullmatch(text) or (not round_too and not text.isalnum()):
            self.at = start
            return False
        self.out += text.translate(table)
        return True

    def raised(self) -> bool:
        for degree in ("^\\circ", "^{\\circ}"):
            if self.taken(degree):
                self.out += "°"
                return True
        last = self.out[-1:]
        if not (last and (last.isascii() and last.isalnum() or last in ")ℕℤℚℝℂ")):
            return False
        return self.script(SUPERSCRIPTS, re.compile("[0-9A-Za-z*]"), True)

    def lowered(self) -> bool:
        return bool(_LETTER.fullmatch(self.out[-1:])) and self.script(SUBSCRIPTS, re.compile("[0-9]+|[A-Za-z]"), False)


def _part(text: str) -> str:
    """A fraction's part, in brackets if it is a sum."""
    t = text.strip()
    return f"({t})" if re.search("[+-]", t[1:]) else t


def _cardinals(text: str) -> str:
    """card(x) as |x|; an open one stays."""
    head, mark, rest = text.partition("card(")
    if not mark:
        return text
    reader = _Printer("(" + rest)
    inner = reader.enclosed("(", ")")
    return text if inner is None else f"{head}|{inner.strip()}|" + _cardinals(reader.source[reader.at :])


def _printed(text: str) -> str:
    # commands that an earlier pass has half replaced
    text = re.sub(r"≤ft\\?\s*", "{ ", re.sub(r"≠g\b", "¬", text))
    shown = _Printer(text).run()
    shown = re.sub(r"\b([A-Za-z])kg\b", r"\1 kg", shown)
    shown = re.sub(r"(?<![A-Za-z])([A-Za-z])(?=(?:sin|cos|tan)\b)", r"\1 ", shown)
    return _cardinals(shown)


def _tidy(text: str) -> str:
    return re.sub(r"\s{2,}", " ", re.sub(r"\s*//\s*", " // ", text)).strip()


def show_latex(text: str) -> str:
    """Plain text of content with LaTeX: formulas between dollars lose their braces."""
    pieces = text.replace("\r\n", "\n").split("$")
    shown = []
    for k, piece in enumerate(pieces):
        is_formula = k % 2 == 1 and k < len(pieces) - 1 and piece
        shown.append(_tidy(re.sub("[{}]", "", _printed(piece))) if is_formula else ("$" if k % 2 == 1 else "") + piece + ("$" if k % 2 == 1 and not piece and k < len(pieces) - 1 else ""))
    return _tidy(_printed("".join(shown)))
