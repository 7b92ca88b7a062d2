"""Symbols and calls of brace languages (JavaScript, TypeScript, Java, Go, Dart) as Spark jobs over tokens.

One regular expression for each language cuts a text into tokens, so that comments,
strings, templates and regular expressions are one token each and hide what they hold. Spark
deals the files over tasks and cuts them; the tokens of some files at a time are arrays, and
marks come from running counts and last or next places in these:

* lines are running counts of line breaks, levels running counts of brackets;
* within a level, brackets open and close in turn, so the next closing one is the match,
  and the last opening one is what a token stands in;
* a name before ``(`` is declared if what stands before it and what follows the matching
  ``)`` say so, else it is a call;
* bodies of declared names are scopes; what declares, opens a scope or calls is a mark, and
  scopes that a file's earlier marks have opened and not closed are its stack.

Only marks are rows again. A file is never larger than a row can be.

Defined results: files without text or of other languages give no rows; unclosed brackets
end at the file's last token; what templates interpolate is not looked into; more than 2000
escapes make a string's rest plain tokens; Dart's named constructors are neither
declared nor called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, LINE, BLOCK = r"\s++", r"//[^\n]*+", r"/\*(?s:.*?)(?:\*/|\z)"
DOUBLE, SINGLE = (q + r"[^Q\\\n]*+(?:\\(?s:.)[^Q\\\n]*+){0,2000}+".replace("Q", q) + q for q in "\"'")
LONG_DOUBLE, LONG_SINGLE = r'"""(?s:.*?)"""', r"'''(?s:.*?)'''"
TEMPLATE, RAW = r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+){0,2000}+`", r"`[^`]*+`"
REGEX = r"/(?<=[=(,:!&|?;{}]\s{0,3}/)(?![*/])(?:[^/\\\n\[]|\\.|\[[^\]\n]{0,200}\]){1,500}+/[a-z]*+"
TYPES = r"<[\w\s,.\[\]?<>]{0,200}>(?=\()"  # type arguments between a name and its parenthesis
PARAMETERS = r"\[(?<=func\s{1,3}\w{1,80}\[)[^\]\n]{1,200}\](?=\()"  # Go's, of a declared name; what stands before is looked at behind the first character only
NAME, SIGN, REST = r"[A-Za-z_$][\w$]*+", r"[(){};,.:\]]", r"\d[\w.]*+|=>|(?s:.)"  # nothing else starts as names and these signs do
#: what a language's texts are cut by, in order of trial
PARTS = {
    "javascript": [SPACE, NAME, SIGN, LINE, BLOCK, TEMPLATE, DOUBLE, SINGLE, REGEX, TYPES, REST],
    "java": [SPACE, NAME, SIGN, LINE, BLOCK, LONG_DOUBLE, DOUBLE, SINGLE, TYPES, REST],
    "go": [SPACE, NAME, SIGN, LINE, BLOCK, RAW, DOUBLE, SINGLE, PARAMETERS, REST],
    "dart": [SPACE, NAME, SIGN, LINE, BLOCK, LONG_DOUBLE, LONG_SINGLE, DOUBLE, SINGLE, TYPES, REST],
}
PARTS["typescript"] = PARTS["javascript"]
BLANK = r"[ \t\r\f\x0B]*+"  # before a token, and no token itself
LANGUAGES = tuple(PARTS)

#: words that stand before a parenthesis without being called, and those that can't stand before a declared name
WORDS = ["if", "for", "while", "switch", "catch", "return", "typeof", "await", "yield", "throw", "else", "do", "function", "func", "super", "this", "new", "delete", "void", "in", "of", "case", "synchronized", "try", "assert", "defer", "go", "select", "range", "interface", "struct", "chan", "map", "class", "enum", "extends", "with", "is", "as", "var", "const", "let", "final", "type", "import"]
UNDECLARED_AFTER = [".", "=", "(", ",", "[", "@", "=>", ":", "!", "&", "|", "+", "-", "*", "/", "<", "return", "new", "await", "throw", "else", "case", "yield", "in", "of"]
#: words of WORDS, or other than types, that may stand between a declaration's parameters and its body
BETWEEN = ["async", "throws", "sync", "void", "is", "typeof", "extends"]


#: tokens that are looked at together; a file is never cut
SLICE = 200_000
#: the codes of tokens that something hangs on: "" (none) is 0, every other token 1
CODES = {t: k for k, t in enumerate(["", None, *sorted({*WORDS, *UNDECLARED_AFTER, *BETWEEN, *"()[]{};?>", "record", "mixin", "extension"})])}


def _codes(*toks: str) -> np.ndarray:
    """A table that holds by code whether a token is one of these."""
    found = np.zeros(len(CODES), bool)
    found[[CODES[t] for t in toks]] = True
    return found


OPENS, CLOSES, ENDS = _codes(*"([{"), _codes(*")]}"), _codes("", "{", "}", ";")
WORD, LOOSE, BOUND = _codes(*WORDS), _codes(*BETWEEN), _codes(*UNDECLARED_AFTER)
TYPE_SIGNS, UNCALLED_AFTER = _codes(*":.?|&[]<>,"), _codes("new", "function", "func", "@")
#: what makes a class by language, which of these are symbols, and what follows the parameters of what is declared
KINDS = {"javascript": _codes("class"), "java": _codes("class", "interface", "enum", "record"), "go": _codes(), "dart": _codes("class", "mixin", "extension", "enum")}
COUNTED = {"javascript": _codes("class"), "java": _codes("class", "interface"), "go": _codes("class"), "dart": _codes("class")}
BODIES = {"javascript": _codes("{"), "java": _codes("{", ";"), "go": _codes(), "dart": _codes("{", "=>", ";", "super", "this", "assert")}
FAMILIES = ("javascript", "java", "go", "dart")
MARKS = "path string, language string, tok string, line int, caller string, inner string, parent string, declared boolean, called boolean, scope string, class_body boolean, counted boolean, class_start int, function_start int, signature int, settled_tok string, settled_line int, start int, close_line int"


def tokens(files: DataFrame) -> DataFrame:
    """path, language and toks, the tokens in order with blanks and comments, of files (path, language, content); texts are dealt over tasks before they become tokens."""
    found = F.array().cast("array<string>")
    for language, parts in PARTS.items():
        found = F.when(F.col("language") == language, F.regexp_extract_all("content", F.lit(f"{BLANK}({'|'.join(parts)})"), F.lit(1))).otherwise(found)
    src = files.filter(F.col("language").isin(*LANGUAGES) & F.col("content").isNotNull()).select("path", "language", "content")
    return src.repartition("path").select("path", "language", found.alias("toks"))


def _trivial(tok: str) -> bool:
    """Blanks, comments, and type arguments or parameters; only of these a token of two or more characters starts so."""
    return tok[0] in "\t\n\x0b\f\r " or tok.startswith(("//", "/*")) or (tok[0] in "<[" and len(tok) > 1)


def _taken(values: pa.Array, at: np.ndarray, here: np.ndarray) -> pa.Array:
    """Values at some places, null elsewhere."""
    return values.take(pa.array(at, mask=~here))


def _stacks(files: list, at: list, until: list, scopes: list, classes: list) -> tuple[list, list, list]:
    """For each mark in order: names of the scopes around it joined by points, the last of these, and the last class among them."""
    out, stack, current = [], [], None
    for file, k, end, scope, is_class in zip(files, at, until, scopes, classes):
        if file != current:
            stack, current = [(float("inf"), None, None, None)], file
        while stack[-1][0] < k:
            stack.pop()
        _, caller, inner, parent = stack[-1]
        out.append((caller, inner, parent))
        if scope is not None:
            stack.append((end, scope if caller is None else f"{caller}.{scope}", scope, scope if is_class else parent))
    return tuple(map(list, zip(*out))) if out else ([], [], [])


def _mark(path: pa.Array, language: pa.Array, lengths: np.ndarray, toks: pa.Array) -> Iterator[pa.RecordBatch]:
    """The marks of some files: running counts and last or next places, over all tokens of these at once."""
    words = toks.dictionary_encode()
    known = words.dictionary.to_pylist()
    of_word = lambda f, kind: np.fromiter(map(f, known), kind, len(known))
    word = words.indices.to_numpy()
    breaks, solid = of_word(lambda t: t.count("\n"), np.int32)[word], ~of_word(_trivial, bool)[word]
    upto = np.cumsum(breaks)
    file = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.cumsum(lengths) - lengths
    line = 1 + upto - breaks - (upto - breaks)[np.minimum(begin, max(len(word) - 1, 0))][file]
    word, file, line = word[solid], file[solid], line[solid].astype(np.int32)
    n, every = len(word), np.arange(len(word))
    if not n:
        return
    edge = np.flatnonzero(np.diff(file, prepend=-1))
    sizes = np.diff(edge, append=n)
    begin, end = np.repeat(edge, sizes), np.repeat(edge + sizes, sizes)  # of each token's file

    def shifted(x, k):
        out = np.zeros_like(x)
        if k > 0:
            out[k:] = np.where(every[k:] - k >= begin[k:], x[:-k], 0)
        else:
            out[:k] = np.where(every[:k] - k < end[:k], x[-k:], 0)
        return out

    def before(mask):
        """The last place before each token where ``mask`` holds in its file, or -1."""
        last = np.concatenate(([-1], np.maximum.accumulate(np.where(mask, every, -1))[:-1]))
        return np.where(last >= begin, last, -1)

    def running(steps):
        upto = np.cumsum(steps)
        return upto - (upto - steps)[begin]

    tok = of_word(lambda t: CODES.get(t, 1), np.int16)[word]
    name = of_word(lambda t: t[0].isascii() and (t[0].isalpha() or t[0] in "_$"), bool)[word]
    before1, before2, after = shifted(tok, 1), shifted(tok, 2), shifted(tok, -1)
    by_family = np.array([FAMILIES.index("javascript" if x == "typescript" else x) for x in language.to_pylist()], np.int8)[file]
    js, java, go, dart = (by_family == k for k in range(4))
    of_family = lambda tables, codes: np.stack([tables[f] for f in FAMILIES])[by_family, codes]
    is_ = lambda codes, *toks: np.isin(codes, [CODES[t] for t in toks]) if len(toks) > 1 else codes == CODES[toks[0]]
    opens, closes = OPENS[tok], CLOSES[tok]
    level = running(opens.astype(np.int32) - closes) + closes
    # what settles how a declaration goes on: the next token that isn't part of a type
    settles = np.where(go, is_(tok, "{") & ~is_(before1, "interface", "struct"), ~((name & (~WORD[tok] | LOOSE[tok])) | TYPE_SIGNS[tok]))
    settled = np.append(np.minimum.accumulate(np.where(settles, every, n)[::-1])[::-1], n)[1:]
    settled = np.where(settled < end, settled, -1)
    # the line of the statement that a token belongs to
    statement = line[np.maximum.accumulate(np.where(ENDS[before1], every, 0))]
    start = np.where(java, statement, line)
    # classes: the brace after ``class Name`` is its body
    kind = before(of_family(KINDS, tok) & shifted(name, -1) & ~is_(before1, "."))
    class_body = is_(tok, "{") & (kind > before(is_(tok, "{", "}", ";")))
    # brackets alternate within a level, so an opening one's match is the next there; names before parentheses stand in the last one
    plain = name & is_(after, "(") & ~WORD[tok]
    at = np.flatnonzero(opens | closes | plain)
    at = at[np.lexsort((level[at], file[at]))]
    same = (file[at][1:] == file[at][:-1]) & (level[at][1:] == level[at][:-1])
    group = np.maximum.accumulate(np.where(np.append(True, same)[: len(at)], 0, np.arange(len(at))))
    last = np.maximum.accumulate(np.where(opens[at], np.arange(len(at)), -1))
    in_class = np.zeros(n, bool)
    in_class[at] = (last >= group) & class_body[at[last]] & (level[at] > 0)
    brackets = at[~plain[at]]
    pair = opens[brackets[:-1]] & closes[brackets[1:]] & (file[brackets[:-1]] == file[brackets[1:]]) & (level[brackets[:-1]] == level[brackets[1:]])
    match = np.full(n + 1, -1)
    match[brackets[:-1][pair]] = brackets[1:][pair]
    closing = np.where(plain, match[1:], -1)
    settled = np.where((closing >= 0) & is_(tok[closing], ")"), settled[closing], -1)  # from here on what follows a name's parentheses
    body = np.where(settled >= 0, tok[settled], 0)
    # a name before a parenthesis: declared or called
    member = in_class & ~BOUND[before1]
    # the ``)`` before a Go name closes a receiver, written (name Type): the last ``func`` is followed by a parenthesis, and no other group has begun since
    func = before(is_(tok, "func"))
    receiver = (func >= 0) & is_(after[func], "(") & (func > before(is_(tok, "(") & ~is_(before1, "func")))
    free = (js & (is_(before1, "function") | (is_(before1, "*") & is_(before2, "function"))) & is_(body, "{")) | (dart & (level == 0) & ~BOUND[before1] & is_(body, "{", "=>"))
    declared = (closing >= 0) & (free | (member & of_family(BODIES, body)) | (go & (is_(before1, "func") | (is_(before1, ")") & receiver))))
    named_constructor = dart & in_class & is_(before1, ".") & is_(body, "{", "=>")
    called = (closing >= 0) & ~declared & ~named_constructor & ~UNCALLED_AFTER[before1]
    # bodies of what is declared are scopes
    function = before(declared & is_(body, "{"))
    own = is_(tok, "{") & (function >= 0) & (settled[function] == every) & ~class_body
    close_line = np.where(match[:-1] >= 0, line[match[:-1]], line[end - 1])
    k = np.flatnonzero(declared | called | class_body | own)
    number = lambda x, here=None: pa.array(x.astype(np.int32), mask=None if here is None else ~here)
    spoken = pa.array(word)
    counted = of_family(COUNTED, tok)[kind]
    c, o, p, z = class_body[k], own[k], closing[k] >= 0, settled[k] >= 0
    scope = words.dictionary.take(_taken(spoken, np.where(c, kind[k] + 1, function[k]), c | o))
    caller, inner, parent = _stacks(file[k].tolist(), k.tolist(), np.where(match[k] >= 0, match[k], n).tolist(), scope.to_pylist(), c.tolist())
    cols = {
        "path": path.take(pa.array(file[k])), "language": language.take(pa.array(file[k])), "tok": words.dictionary.take(spoken.take(pa.array(k))), "line": number(line[k]), "caller": pa.array(caller, pa.string()), "inner": pa.array(inner, pa.string()), "parent": pa.array(parent, pa.string()),
        "declared": pa.array(declared[k]), "called": pa.array(called[k]), "scope": scope, "class_body": pa.array(c), "counted": pa.array(counted[k], mask=~c),
        "class_start": number(statement[kind[k]], c), "function_start": number(start[function[k]], o), "signature": number(line[closing[k]], p), "settled_tok": words.dictionary.take(_taken(spoken, settled[k], z)), "settled_line": number(line[settled[k]], z),
        "start": number(start[k]), "close_line": number(close_line[k]),
    }
    yield pa.RecordBatch.from_pydict(cols)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = pc.list_value_length(batch["toks"]).to_numpy()
        last = np.append(np.diff(np.cumsum(lengths) // SLICE) > 0, True)[: len(lengths)]
        ends = [0, *np.flatnonzero(last) + 1]
        for a, b in zip(ends, ends[1:]):
            if lengths[a:b].any():
                part = batch.slice(a, b - a)
                yield from _mark(part["path"], part["language"], lengths[a:b], part["toks"].flatten())


def marked(files: DataFrame) -> DataFrame:
    """Tokens that declare a name, open its body, or call: with the scopes that they stand in.

    Files are dealt over tasks; within one, tokens of some files at a time are arrays, on
    which running counts and last places are single steps.
    """
    return tokens(files).mapInArrow(_marks, MARKS)


def symbols_and_calls(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of files (path, language, content).

    Symbols: path, type, name, start_line, end_line, parent_class. Calls: path, caller (the
    scopes around it, joined by points), callee, line; distinct, without those of the
    innermost scope itself and those outside of any.
    """
    rows = marked(files)
    is_class, body = F.col("class_body") & F.coalesce("counted", F.lit(False)), F.col("scope").isNotNull() & ~F.col("class_body") & (F.col("language") != "dart")
    signature_only = (F.col("language") == "dart") | (F.col("settled_tok") != "{")
    bare = F.col("declared") & F.coalesce(signature_only, F.lit(False))
    ends = F.when(F.col("language") == "java", F.col("settled_line")).otherwise(F.col("signature"))
    first = F.when(is_class, F.col("class_start")).when(body, F.col("function_start")).otherwise(F.col("start"))
    symbols = rows.filter(is_class | body | bare).select("path", F.when(is_class, "class").otherwise("function").alias("type"), F.coalesce("scope", "tok").alias("name"), first.alias("start_line"), F.when(bare, ends).otherwise(F.col("close_line")).alias("end_line"), F.when(~is_class, F.col("parent")).alias("parent_class"))
    calls = rows.filter(F.col("called") & F.col("caller").isNotNull() & (F.col("tok") != F.col("inner")))
    return symbols, calls.select("path", "caller", F.col("tok").alias("callee"), "line").distinct()
