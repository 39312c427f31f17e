"""Whether a documentation comment tells a reader more than the name and the signature do.

A comment is read as lines without its marks. Lines that are code, tool
directives or separators say nothing, nor do short sentences about documentation that is missing or to come. Of the rest,
the words that remain after removing function words of four languages, the words of the name and the signature, and
words that stand in for documentation are its information. Without any, the comment is trivial.
"""

from __future__ import annotations

import re
import unicodedata

from skein.sources.lexing import words

#: Function words and fillers of documentation in English, German, Spanish and French.
FILLERS = frozenset(
    """
a an the this that these those it its is are was be been being do does done did has have had will would can could may of to in on at by for from with as and or not no
if then else when here there which who what where how so too also just only very all any each some such same own other another more most
function functions method methods fn func def procedure routine helper constructor destructor getter setter class struct object module member implementation implements implement
returns return returned returning result results value values output gets get getting sets set setting used use uses using called call calls calling
param params parameter parameters arg args argument arguments type types raises throws self void none null begin begins end start starts perform performs performing handle handles run runs execute executes
one two code main name named given instance given public private protected static async internal
der die das den dem des ein eine einer eines einem einen und oder ist sind wird werden im in zu zum zur von vom mit für auf als auch nicht funktion methode gibt zurück liefert
el la los las un una unos unas y o es son se de del al en por para con como que no su sus función método devuelve retorna
le la les un une des du de et ou est sont se à au aux en par pour avec comme que qui ne pas son ses fonction méthode renvoie retourne
""".split()
)
#: Words that stand in for documentation, and words for documentation itself.
PLACEHOLDERS = frozenset(
    """
todo fixme xxx hack tbd wip nyi tba someone documentation document documents documented undocumented docstring doc docs comment comments describe description described descriptions
provide provided missing needed please later soon
see above below ditto idem same overload overloads lorem ipsum dolor sit amet placeholder text auto generated autogenerated generate stub api deprecated obsolete legacy other inheritdoc inherited inherit summary remarks note
n/a foo bar baz blah etc
beschreibung dokumentation dokumentieren dokumentiert später siehe oben
documentar documentado documentación descripción ver arriba
documenter documenté documentation description plus tard voir dessus ci
""".split()
)
#: Words for documentation, and words that put something off or ask for it, in four languages. A sentence with both speaks of missing documentation.
_ABOUT_DOCS = re.compile(r"(?i)\b(?:documentation|documented?|documenting|docs?|docstrings?|descriptions?|descri(?:be|bed)|comments?|(?:write|written|writing) (?:this|it|that|me|up|down|something)\b(?: up| down)?|explain(?:ed)?|dokumentation|dokumentier\w*|beschreib\w*|documentar|documentad\w+|documentaci\w+|descripci\w+|describir|documenter|documentée?|décrire)\b")
_PUT_OFF = re.compile(
    r"(?i)\b(?:todo|fixme|tbd|tba|wip|xxx|later|soon|missing|pending|please|someone|somebody|should|must|needs?|needed|goes|go|here|yet|not|no|without|to be|will be|add|fill|write|your?|me|coming|unfinished|incomplete"
    r"|folgt|fehlt|noch|bitte|später|nicht|keine|pendiente|falta|después|luego|sin|por|manque|manquante|venir|tard|pas|sans|à)\b"
)
_NOTICE = re.compile(r"(?i)^\W*(?:wip|todo|fixme|xxx|tbd|draft)\b\W*(?:do not|don't|please)\b")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Most words of a sentence that says only that documentation is missing.
SHORT = 16
#: Marks with which tools are told something.
DIRECTIVES = re.compile(
    r"(?i)^\W*(?:eslint-|tslint:|jshint|jslint|prettier-ignore|@ts-|istanbul |c8 |nolint|noqa|type:\s*ignore|pylint:|flake8|mypy:|pyright:|fmt:|yapf:|isort:|pragma|clippy::|rustfmt|rustc|noinspection|@?suppresswarnings|checkstyle|coverage:|go:\w+|\+build|#?region|#?endregion|vim?:|-\*-|sonar|nosec|bandit|shellcheck|biome-ignore|deno-lint)"
)
#: Banners and licences, which are about the file.
BANNERS = re.compile(r"(?i)^(?:@?[\w.-]+ v?\d+(?:\.\d+)*|spdx-license-identifier\b.*|copyright\b.*|\(c\) .*|©.*|licensed under\b.*|.*all rights (?:reserved|kept)\.?)$")
_MARK = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!/)|//[/!]*|#+!?|--+|<!--|;+)?[ \t]*|[ \t]*(?:\*+/|-->)\s*$")
_CODE = re.compile(
    r"^(?:(?:return|let|const|var|if|elif|else|for|while|def|fn|func|function|import|from|use|pub|class|switch|case|try|catch|throw|raise|assert|print|async|await|static|public|private|int|void|match|package)\b.*(?:[=;{}]|\w\(|:$).*"
    r"|[\w.\[\]]+\s*(?:[-+*/|&:]?=)\s*\S.*[;)\]\d\w]|[\w.]+\([^)]*\)\s*;|[{}()\[\];,\s]+|return(?:\s+[\w.]+)?;?|\}.*|.*[;{]\s*)$"
)
_TAG = re.compile(r"</?[\w:]+[^>]*>|\{@\w+|[@\\:](?:param|arg|argument|returns?|type|rtype|throws|raises|exception|see|since|author|version|template|typeparam)\b")
_NAME_TAG = re.compile(r"(?:[@\\](?:param|arg)\s+(?:\{[^}]*\}\s*)?|:param\s+)(\w+)\s*:?|^\s*(\w+)\s*:(?=\s)")


def clean(doc: str) -> list[str]:
    """The lines of a comment without its marks."""
    out = []
    for line in doc.replace("\r", "").split("\n"):
        while (shorter := _MARK.sub("", line, count=1)) != line and line:
            line = shorter
        line = re.sub(r"[ \t]*(?:\*+/|-->)\s*$", "", line).strip()
        if line:
            out.append(line)
    return out


def _stem(word: str) -> str:
    for end in ("ing", "ies", "es", "ed", "s", "e"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


def put_off(sentence: str) -> bool:
    """Whether a sentence speaks of documentation that is missing or to come, and so of nothing else."""
    if len(sentence.split()) > SHORT:
        return False
    return bool(_NOTICE.match(sentence) or (_ABOUT_DOCS.search(sentence) and _PUT_OFF.search(sentence)))


def information(doc: str, name: str, signature: str) -> list[str]:
    """The words of a comment that neither name, signature nor convention account for."""
    known = set(words(name)) | set(words(signature))
    known |= {_stem(w) for w in known} | {name.lower()}
    known |= {w.lower() for w in re.findall(r"\w+", signature)}
    out = []
    for line in clean(unicodedata.normalize("NFC", doc)):
        if DIRECTIVES.match(line) or BANNERS.match(line) or _CODE.match(line):
            continue
        tagged = {g.lower() for m in _NAME_TAG.finditer(line) for g in m.groups() if g}
        line = " ".join(x for x in _SENTENCE.split(line) if not put_off(x))
        for raw in re.findall(r"[^\W_]+(?:['’][^\W_]+)?", _TAG.sub(" ", line)):
            for w in words(raw) or (raw.lower(),):
                if len(w) < 2 and not w.isdigit() or w in FILLERS or w in PLACEHOLDERS or w in known or w in tagged or _stem(w) in known:
                    continue
                out.append(w)
    return out


def is_trivial(doc: str | None, name: str, signature: str) -> bool:
    """True for no, empty or trivial documentation."""
    return not doc or not information(doc, name, signature)
