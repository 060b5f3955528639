"""Which documents of a collection of platforms are something else: features of the text, then arms over the features.

What the words of a collection are is a parameter; the features and the thresholds of the arms are not.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import spread


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


@dataclass(frozen=True)
class Lexicon:
    """Words (without accents, lower-case) and patterns that the predicates look for."""

    # Words of Portuguese, Spanish and English platforms; pass others for other collections.
    action: frozenset[str] = _set("ampliar criar construir melhorar garantir implantar fortalecer reformar apoiar promover incentivar valorizar reduzir investir fiscalizar concluir crear mejorar ampliaremos construiremos create build improve expand strengthen support protect reduce invest repair")
    deverbal: frozenset[str] = _set("ampliacao criacao construcao melhoria implantacao reforma apoio promocao incentivo valorizacao reducao creacion mejora expansion creation construction improvement repair")
    preposition: frozenset[str] = _set("de do da dos das ao aos del para of for to")
    structure: frozenset[str] = _set("plano programa proposta secretaria capitulo eixo anexo indice plan program chapter section annex index")
    domain: frozenset[str] = _set("saude educacao seguranca transporte habitacao cultura esporte lazer turismo meio ambiente saneamento agricultura assistencia social administracao health education security transport housing culture sport environment agriculture salud educacion vivienda")
    stopword: frozenset[str] = _set("a o as os e de do da dos das em no na the and of in y la el los las")
    verb: frozenset[str] = _set("e sao foi esta estao tem vai vamos deve devem pode podem precisa quer sera serao is are was were will has have must should es son esta tiene")
    bio: tuple[str, ...] = (r"\bnasci|\bnasceu", r"\bcasad[oa]\b", r"\bformad[oa]\b|\bgraduad[oa]\b", r"\bfilh[oa]s? de\b", r"\bwas born\b|\bgraduated\b|\bmarried to\b")
    appeal: tuple[str, ...] = (r"\bvote\b|\bvoten?\b", r"\bconto com (?:voc|o seu)", r"\bpe[çc]o o seu\b", r"\bjoin (?:us|me)\b")
    campaign: tuple[str, ...] = (r"caderno de campanha", r"p[úu]blico[- ]alvo da campanha", r"discurso padronizado", r"preencha|insira aqui", r"modelo de plano", r"campaign workbook|fill in here")
    judicial: tuple[str, ...] = (r"ju[íi]z[oa]? eleitoral", r"nos autos\b", r"pede deferimento", r"excelent[íi]ssim", r"minist[ée]rio p[úu]blico eleitoral", r"certid[ãa]o", r"outorgante", r"\bplaintiff\b|\bhonou?rable court\b")
    party_act: tuple[str, ...] = (r"ata (?:da|de) conven[çc][ãa]o", r"edital de convoca[çc][ãa]o", r"conven[çc][ãa]o partid[áa]ria", r"minutes of the convention")
    defer: tuple[str, ...] = (r"ser[áa] apresentad[oa]", r"em breve[^.]{0,80}plano", r"plano completo", r"no decorrer da campanha", r"full plan will follow")
    compiled: dict = field(default_factory=dict, compare=False, hash=False, repr=False)

    def patterns(self, name: str) -> list[re.Pattern]:
        return self.compiled.setdefault(name, [re.compile(p, re.I) for p in getattr(self, name)])

    def __getstate__(self) -> dict:
        return {**self.__dict__, "compiled": {}}


PORTABLE = Lexicon()
NUMBERS = ("n_words", "n_lines", "n_clause", "n_label", "n_number", "n_prop", "n_table", "n_item", "n_table_prop", "n_domain_item", "n_bullet", "bio", "campaign", "judicial", "party_act", "defer")
_BULLET = re.compile(r"\s*(?:[-–—•●▪*·►✓]|\(?[a-zA-Z0-9]{1,2}[.)])\s+")
_LEAD = re.compile(r"\A\s*(?:[-–—•●▪*·►✓|\s]+|\(?\d{1,3}(?:\.\d{1,3})*\s*[.)ºª°–-]|\(?[a-zA-Z]\))+\s*")
_PIECES = re.compile(r"[.;:!?]\s+|\s+[•●▪►]\s*")
_HEADER = re.compile(r"\s*#{1,6}\s|^[^a-zß-öø-ÿ]{4,}$")
_FINITE = re.compile(r"\w{2,}(?:ra|rao|aremos|eremos|iremos|ou|aram|eram|iram|amos|emos|imos)\b")
_WORD = re.compile(r"\w+")


def plain(text: str) -> str:
    """Lower-case without accents."""
    low = text.lower()
    return low if low.isascii() else "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c))


def words_of(line: str) -> list[str]:
    return _WORD.findall(plain(line))


def table_cells(line: str) -> list[str] | None:
    """Cells of a table row that are not empty; None for other lines."""
    s = line.strip()
    if s.startswith("|"):
        return [c for x in s.strip("|").split("|") if (c := x.strip())]
    return [c for x in s.split("\t") if (c := x.strip())] if "\t" in s else None


def has_finite_verb(text: str, lexicon: Lexicon = PORTABLE) -> bool:
    w = words_of(text)
    return any(x in lexicon.verb for x in w) or any(_FINITE.fullmatch(x) and x not in lexicon.deverbal for x in w)


def is_domain_label(line: str, lexicon: Lexicon = PORTABLE) -> bool:
    """A line of at most six words that names domains and nothing else."""
    w = [x for x in words_of(_LEAD.sub("", line, count=1)) if x not in lexicon.stopword]
    return 0 < len(w) <= 6 and all(x in lexicon.domain for x in w)


def opens_with_action(piece: str, lexicon: Lexicon = PORTABLE) -> bool:
    """Whether one of the first two words is a verb of action, or one of the first three a noun made from one that a
    preposition soon follows, without naming a mere domain between."""
    w = words_of(_LEAD.sub("", piece, count=1))
    if len(w) < 2 or w[0] in lexicon.structure:
        return False
    if w[0] in lexicon.action or w[1] in lexicon.action:
        return True
    for i, x in enumerate(w[:3]):
        if x in lexicon.deverbal and not any(y in lexicon.structure for y in w[:i]):
            j = next((j for j in range(i + 1, min(i + 5, len(w))) if w[j] in lexicon.preposition), None)
            between = w[i + 1 : j] if j is not None else []
            if j is not None and not (between and all(y in lexicon.domain or y in lexicon.stopword for y in between)):
                return True
    return False


def is_proposal(piece: str, lexicon: Lexicon = PORTABLE) -> bool:
    """A piece that opens with an action and is marked as an item or no sentence of its own."""
    return opens_with_action(piece, lexicon) and (bool(_BULLET.match(piece.lstrip("| "))) or not has_finite_verb(piece, lexicon))


def features(text: str, lexicon: Lexicon = PORTABLE) -> dict:
    """The nineteen features of a document; empty text gives zeros."""
    lines = [y for x in text.split("\n") if (y := x.strip())]
    out: dict = dict.fromkeys(NUMBERS, 0)
    out |= {"n_words": len(_WORD.findall(text)), "n_lines": len(lines)}
    for x in lines:
        w, row, header = _WORD.findall(x), table_cells(x), bool(_HEADER.match(x))
        label = is_domain_label(x, lexicon)
        number = bool(w) and all(map(str.isdigit, w))
        is_row = row is not None and len(row) >= 2
        out["n_clause"] += not header and len(w) >= 8 and has_finite_verb(x, lexicon)
        out["n_label"] += label
        out["n_number"] += number
        out["n_table"] += is_row
        out["n_prop"] += not is_row and any(is_proposal(p, lexicon) for p in _PIECES.split(x) if p.strip())
        out["n_table_prop"] += is_row and any(is_proposal(p, lexicon) for c in row for p in _PIECES.split(c) if p.strip())
        out["n_bullet"] += bool(_BULLET.match(x))
        if not header and not label and not number and row is None and 1 < len(w) <= 25:
            out["n_item"] += 1
            first = words_of(_LEAD.sub("", x, count=1))
            out["n_domain_item"] += bool(first) and first[0] in lexicon.domain
    for name in ("bio", "campaign", "judicial", "party_act", "defer"):
        out[name] = sum(bool(p.search(text)) for p in lexicon.patterns(name))
    out["appeal"] = any(p.search(text) for p in lexicon.patterns("appeal"))
    last = max((m.start() for p in lexicon.patterns("judicial") for m in p.finditer(text)), default=-1)
    out["judicial_deep"] = last / max(1, len(text))
    out["first_line"] = lines[0][:200] if lines else ""
    return out


def screen_features(df: DataFrame, doc: str = "doc_id", text: str = "text", lexicon: Lexicon = PORTABLE) -> DataFrame:
    """doc and the features of every row; a null text counts as empty."""
    kind = dict(df.dtypes)[doc]
    rows = spread(df.select(F.col(doc).alias("doc"), F.coalesce(text, F.lit("")).alias("t")))
    sql = f"doc {kind}, " + ", ".join(f"{f} bigint" for f in NUMBERS) + ", appeal boolean, judicial_deep double, first_line string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fs = [features(t, lexicon) for t in b.column(1).to_pylist()]
            more = [pa.array([f["appeal"] for f in fs], pa.bool_()), pa.array([f["judicial_deep"] for f in fs], pa.float64()), pa.array([f["first_line"] for f in fs], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([int(f[k]) for f in fs], pa.int64()) for k in NUMBERS), *more], names=["doc", *NUMBERS, "appeal", "judicial_deep", "first_line"])

    return rows.mapInArrow(run, sql)


def arms() -> Column:
    """The set of arms that fire, as a sorted string of their letters; empty for a platform.

    A campaign workbook, B court or registry filing, C letter or CV, D no content, E contents page and a letter, F extract
    of a longer document, G annex of tables, H shattered extraction, I minutes, J plan to be filed later. Most hold only
    where nothing is proposed.
    """
    c = F.col
    none = (c("n_prop") == 0) & (c("n_table_prop") == 0)
    contents = (c("n_label") >= 4) & none
    numbered = r"^[\s#*]*(\d{1,2})\.(\d{1,2})(?!\d)"
    part = lambda i: F.coalesce(F.regexp_extract("first_line", numbered, i).try_cast("int"), F.lit(-1))
    deep = (part(1) >= 0) & (part(1) <= 30) & (part(2) <= 30) & ((part(1) > 1) | (part(2) > 1)) & ~c("first_line").rlike(r"\d{2}\.\d{3}\.\d{3}/\d{4}")
    rules = {
        "A": c("campaign") >= 2,
        "B": (c("judicial") >= 2) & none & ((c("judicial_deep") >= 0.4) | (c("n_words") < 600)),
        "C": (c("bio") >= 3) & c("appeal") & (c("n_bullet") <= 2) & (c("n_words") < 2000) & none,
        "D": (c("n_clause") == 0) & none & (c("n_domain_item") == 0),
        "E": contents & (c("n_item") <= 5) & (c("n_clause") <= 6) & (c("appeal") | (c("bio") >= 1)),
        "F": deep,
        "G": (c("n_table") >= 10) & (c("n_prop") == 0) & (c("n_clause") <= 6) & (c("n_table_prop") < 0.35 * c("n_table")),
        "H": (c("n_number") >= 3) & (c("n_number") >= 0.15 * c("n_lines")) & (c("n_clause") == 0),
        "I": (c("party_act") >= 2) & none,
        "J": contents & (c("defer") >= 1),
    }
    fired = F.concat(*(F.when(r, F.lit(a)).otherwise("") for a, r in rules.items()))
    return F.when(c("n_lines") == 0, "D").otherwise(fired)
