"""Running prose of texts in typesetting markup, and its counts of sentences, words and syllables."""

from __future__ import annotations

import re
import zlib

import numpy as np

# fixed values: environments and commands whose content is no running prose
_DROP_ENVS = "comment equation align gather multline eqnarray displaymath math figure table tabular thebibliography verbatim lstlisting tikzpicture algorithm".split()
_DROP_ARGS = (
    "documentclass usepackage title author date cite citep citet ref eqref label pageref includegraphics include input subfile "
    "bibliography bibliographystyle bibitem caption section subsection subsubsection chapter part paragraph vspace hspace url"
).split()

_COMMENT = re.compile(r"(?<!\\)%[^\n]*\n?")
_OFF = re.compile(r"\\iffalse\b.*?(?:\\fi\b|\Z)", re.S)
_ENV = re.compile(r"\\begin\{(" + "|".join(_DROP_ENVS) + r")(\*?)\}.*?(?:\\end\{\1\2\}|\Z)", re.S)
_MACRO = re.compile(r"\\(?:re)?newcommand\*?\s*\{?\\([A-Za-z]+)\}?(\[[^\]]*\])*\s*\{|\\def\s*\\([A-Za-z]+)\s*\{")
_DISPLAY = re.compile(r"\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)", re.S)
_INLINE = re.compile(r"(?<!\\)\$(?:[^$\n]|\n(?!\s*\n))*?(?<!\\)\$")
_DROP = re.compile(r"~?\\(?:" + "|".join(_DROP_ARGS) + r")\*?(?:\s*\[[^\]]*\])*\s*(?:\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}?)?")
_BEGIN_END = re.compile(r"\\(?:begin|end)\{[^}]*\}?(?:\[[^\]]*\])?")
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?\s?(?:\{\})?|\\[^A-Za-z]")
_PARAGRAPH = re.compile(r"\n[ \t]*\n|\\item\b|\\par\b")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ENDS = re.compile(r"[.!?][\"'”’)\]]*$")
_INITIAL = re.compile(r"[A-Z]\.$")
_VOWELS = re.compile(r"[aeiouyàâäáéèêëíîïóôöúùûü]+")
# fixed values: words whose full stop ends no sentence
_NO_END = frozenset("eg ie fig figs eq eqs sec ref refs cf vs dr prof".split())


def _braced(text: str, start: int) -> int:
    """Index just after the brace that closes the one before start."""
    depth = 1
    for i in range(start, len(text)):
        c = text[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
    return len(text)


def running_prose(text: str) -> list[str]:
    """Paragraphs of running prose. Macros without arguments that the text defines are spelled out, undefined ones dropped."""
    text = text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if "\\" in text or "%" in text or "$" in text:
        text = _COMMENT.sub("", text)
        macros, out, last = {}, [], 0
        for m in _MACRO.finditer(text):
            if m.start() < last:
                continue
            end = _braced(text, m.end())
            macros[m[1] or m[3]] = text[m.end() : end - 1]
            out.append(text[last : m.start()])
            last = end
        text = "".join([*out, text[last:]])
        begin = text.find("\\begin{document}")
        if begin >= 0:
            text = text[begin + 16 :]
        stop = text.find("\\end{document}")
        if stop >= 0:
            text = text[:stop]
        text = _OFF.sub("", text)
        text = _ENV.sub("\n\n", text)
        text = _DISPLAY.sub("\n\n", text)
        text = _INLINE.sub(" ", text)
        text = _DROP.sub(" ", text)
        text = _BEGIN_END.sub("\n\n", text)
        parts = _PARAGRAPH.split(text)
        parts = [_COMMAND.sub(lambda m: macros.get(m[1], " ") + " " if m[1] else " ", p) for p in parts]
        parts = [_COMMAND.sub(" ", p).replace("{", "").replace("}", "") for p in parts]
    else:
        parts = _PARAGRAPH.split(text)
    return [p for p in (x.replace("~", " ").strip() for x in parts) if p]


def syllables(word: str) -> int:
    """Vowel groups of each part of a word, without a final silent e (not -le), at least one a part."""
    n = 0
    for part in re.split(r"['’-]", word.lower()):
        k = len(_VOWELS.findall(part))
        n += max(1, k - (k > 1 and part.endswith("e") and not part.endswith("le")))
    return n


class Tokens(dict):
    """What one blank-separated token adds, computed once a token: words | syllables << 16 | sentence ends << 32 | item << 40."""

    def __init__(self, items: int, most: int = 400_000):
        super().__init__()
        self.items, self.most = items, most

    def __missing__(self, token: str) -> int:
        words = _WORD.findall(token)
        ends = _ENDS.search(token) is not None and not (words and (words[-1].lower() in _NO_END or _INITIAL.match(token)))
        item = zlib.crc32(words[0].lower().encode()) % self.items if words else 0
        if len(self) > self.most:
            self.clear()
        self[token] = v = len(words) | sum(map(syllables, words)) << 16 | ends << 32 | item << 40
        return v


def counts(text: str, tokens: Tokens) -> tuple[int, int, int, np.ndarray]:
    """(words, sentences, syllables, item of every word token) of the running prose; a paragraph's end ends a sentence."""
    p = " . ".join(running_prose(text)).replace("e.g.", "eg").replace("i.e.", "ie")  # a lone stop ends the paragraph's last sentence
    found = np.fromiter(map(tokens.__getitem__, p.split()), np.int64)
    word = (found & 0xFFFF) > 0
    if not word.any():
        return 0, 0, 0, np.zeros(0, np.int64)
    begun = np.add.reduceat(word, np.concatenate([[0], np.flatnonzero(found[:-1] >> 32 & 1) + 1]))  # words of each sentence
    return int((found & 0xFFFF).sum()), int((begun > 0).sum()), int((found >> 16 & 0xFFFF).sum()), found[word] >> 40

