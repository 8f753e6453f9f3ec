"""License scan by ordered signature rules with a keyword gate.

A rule is a regular expression with a label, a priority and a confidence, and is tried only on
texts that hold one of its keywords; one automaton finds the keywords of all rules in a single
pass. Detections that lie inside another of higher priority (or of equal priority and greater
length) are dropped. The rules are broadcast with the task's code: their number is fixed by
this module, not by the data. The plan is one scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.tables import table
from ledgerloom.llm.text import byte_class, chunks, runs, utf8

#: Every ASCII byte that is not a digit or a lower-case letter separates words.
SEPARATORS = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))


@dataclass(frozen=True)
class Rule:
    """Signature of a license. pattern: over lower-cased text; keywords: any of them, white space as one space, opens the gate; every match of pattern must hold one."""

    name: str
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float


#: label: (keywords, pattern of the name, identifier pattern). Written by hand; every entry gives a rule per phrasing.
FAMILIES: dict[str, tuple[tuple[str, ...], str, str]] = {
    "mit": (("mit", "expat"), r"(?:mit|expat)(?:/x11)?", r"mit"),
    "mit-0": (("mit",), r"mit\s+no\s+attribution", r"mit-0"),
    "apache-1.1": (("apache",), r"apache(?:\s+software)?\s+licen[sc]e,?\s*(?:version\s*|v\.?\s*)?1\.1", r"apache-1\.1"),
    "apache-2.0": (("apache",), r"apache(?:\s+software)?(?:\s+licen[sc]e)?,?\s*(?:version\s*|v\.?\s*)?2(?:\.0)?", r"apache-2\.0"),
    "gpl-1.0": (("general public", "gpl"), r"(?:gnu\s+)?(?:general\s+public\s+licen[sc]e|gpl),?\s*(?:version\s*|v\.?\s*)1(?:\.0)?", r"gpl-1\.0(?:-only|-or-later|\+)?"),
    "gpl-2.0": (("general public", "gpl"), r"(?:gnu\s+)?(?:general\s+public\s+licen[sc]e|gpl),?\s*(?:version\s*|v\.?\s*)2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?"),
    "gpl-3.0": (("general public", "gpl"), r"(?:gnu\s+)?(?:general\s+public\s+licen[sc]e|gpl),?\s*(?:version\s*|v\.?\s*)3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?"),
    "lgpl-2.0": (("library general", "lgpl"), r"(?:gnu\s+)?(?:library\s+general\s+public\s+licen[sc]e|lgpl),?\s*(?:version\s*|v\.?\s*)2(?:\.0)?(?!\.)", r"lgpl-2\.0(?:-only|-or-later|\+)?"),
    "lgpl-2.1": (("lesser general", "lgpl"), r"(?:gnu\s+)?(?:lesser\s+general\s+public\s+licen[sc]e|lgpl),?\s*(?:version\s*|v\.?\s*)2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?"),
    "lgpl-3.0": (("lesser general", "lgpl"), r"(?:gnu\s+)?(?:lesser\s+general\s+public\s+licen[sc]e|lgpl),?\s*(?:version\s*|v\.?\s*)3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?"),
    "agpl-3.0": (("affero", "agpl"), r"(?:gnu\s+)?(?:affero\s+general\s+public\s+licen[sc]e|agpl)(?:,?\s*(?:version\s*|v\.?\s*)3(?:\.0)?)?", r"agpl-3\.0(?:-only|-or-later|\+)?"),
    "fdl": (("free documentation", "gfdl"), r"(?:gnu\s+)?(?:free\s+documentation\s+licen[sc]e|gfdl)(?:,?\s*(?:version\s*|v\.?\s*)1\.[123])?", r"gfdl-1\.[123]\S*"),
    "bsd-2-clause": (("bsd",), r"(?:bsd\s+2(?:-\s*|\s+)clause|2(?:-\s*|\s+)clause\s+bsd|simplified\s+bsd|freebsd)", r"bsd-2-clause"),
    "bsd-3-clause": (("bsd",), r"(?:bsd\s+3(?:-\s*|\s+)clause|3(?:-\s*|\s+)clause\s+bsd|new\s+bsd|modified\s+bsd|revised\s+bsd)", r"bsd-3-clause"),
    "bsd-4-clause": (("bsd",), r"(?:bsd\s+4(?:-\s*|\s+)clause|4(?:-\s*|\s+)clause\s+bsd|original\s+bsd)", r"bsd-4-clause"),
    "0bsd": (("bsd",), r"(?:zero(?:-\s*|\s+)clause\s+bsd|0bsd)", r"0bsd"),
    "isc": (("isc",), r"isc", r"isc"),
    "mpl-1.1": (("mozilla", "mpl"), r"(?:mozilla\s+public\s+licen[sc]e|mpl),?\s*(?:version\s*|v\.?\s*)?1\.1", r"mpl-1\.1"),
    "mpl-2.0": (("mozilla", "mpl"), r"(?:mozilla\s+public\s+licen[sc]e|mpl),?\s*(?:version\s*|v\.?\s*)?2(?:\.0)?", r"mpl-2\.0"),
    "epl-1.0": (("eclipse", "epl"), r"(?:eclipse\s+public\s+licen[sc]e|epl)\s*-?,?\s*(?:version\s*|v\.?\s*)?1(?:\.0)?", r"epl-1\.0"),
    "epl-2.0": (("eclipse", "epl"), r"(?:eclipse\s+public\s+licen[sc]e|epl)\s*-?,?\s*(?:version\s*|v\.?\s*)?2(?:\.0)?", r"epl-2\.0"),
    "cddl-1.0": (("common development", "cddl"), r"(?:common\s+development\s+and\s+distribution\s+licen[sc]e|cddl)(?:,?\s*(?:version\s*|v\.?\s*)?1(?:\.[01])?)?", r"cddl-1\.[01]"),
    "cpl-1.0": (("common public", "cpl-"), r"common\s+public\s+licen[sc]e(?:,?\s*(?:version\s*)?1\.0)?", r"cpl-1\.0"),
    "eupl-1.2": (("european union public", "eupl"), r"(?:european\s+union\s+public\s+licen[sc]e|eupl)(?:,?\s*(?:version\s*|v\.?\s*)?1\.[12])?", r"eupl-1\.[12]"),
    "artistic-1.0": (("artistic",), r"artistic\s+licen[sc]e,?\s*(?:version\s*)?1(?:\.0)?", r"artistic-1\.0\S*"),
    "artistic-2.0": (("artistic",), r"artistic\s+licen[sc]e,?\s*(?:version\s*)?2(?:\.0)?", r"artistic-2\.0"),
    "boost-1.0": (("boost", "bsl"), r"boost\s+software\s+licen[sc]e(?:,?\s*-?\s*(?:version\s*)?1\.0)?", r"bsl-1\.0"),
    "busl-1.1": (("business source", "busl-"), r"business\s+source\s+licen[sc]e(?:\s+1\.1)?", r"busl-1\.1"),
    "sspl-1.0": (("server side public", "sspl"), r"(?:server\s+side\s+public\s+licen[sc]e|sspl)", r"sspl-1\.0"),
    "elastic-2.0": (("elastic",), r"elastic\s+licen[sc]e(?:\s+2\.0)?", r"elastic-2\.0"),
    "zlib": (("zlib",), r"zlib(?:/libpng)?", r"zlib"),
    "unlicense": (("unlicense",), r"(?:the\s+)?unlicense", r"unlicense"),
    "wtfpl": (("wtfpl", "do what the"), r"(?:wtfpl|do\s+what\s+the\s+\S+\s+you\s+want\s+to\s+public\s+licen[sc]e)", r"wtfpl"),
    "python-2.0": (("python", "psf"), r"(?:python\s+software\s+foundation|psf)(?:\s+licen[sc]e)?(?:\s+version\s+2)?", r"(?:python|psf)-2\.0"),
    "php-3.01": (("php",), r"php\s+licen[sc]e(?:,?\s*(?:version\s*)?3\.01?)?", r"php-3\.01?"),
    "ruby": (("ruby",), r"ruby(?:'s)?\s+licen[sc]e", r"ruby"),
    "openssl": (("openssl",), r"openssl", r"openssl"),
    "postgresql": (("postgresql",), r"postgresql", r"postgresql"),
    "ofl-1.1": (("open font", "ofl"), r"(?:sil\s+)?open\s+font\s+licen[sc]e(?:,?\s*(?:version\s*)?1\.[01])?", r"ofl-1\.[01]"),
    "ncsa": (("ncsa", "university of illinois"), r"(?:university\s+of\s+illinois/)?ncsa(?:\s+open\s+source)?", r"ncsa"),
    "upl-1.0": (("universal permissive", "upl-"), r"universal\s+permissive\s+licen[sc]e(?:\s*v?\s*1\.0)?", r"upl-1\.0"),
    "mspl": (("microsoft public", "ms-pl"), r"microsoft\s+public\s+licen[sc]e", r"ms-pl"),
    "msrl": (("microsoft reciprocal", "ms-rl"), r"microsoft\s+reciprocal\s+licen[sc]e", r"ms-rl"),
    "odbl-1.0": (("open database", "odbl"), r"(?:open\s+database\s+licen[sc]e|odbl)", r"odbl-1\.0"),
    "odc-by-1.0": (("open data commons", "odc-by"), r"(?:open\s+data\s+commons\s+attribution\s+licen[sc]e|odc-by)", r"odc-by-1\.0"),
    "pddl-1.0": (("public domain dedication", "pddl"), r"public\s+domain\s+dedication\s+and\s+licen[sc]e", r"pddl-1\.0"),
    "cc0-1.0": (("cc0", "creative commons zero"), r"(?:cc0|creative\s+commons\s+zero)(?:\s*1\.0)?", r"cc0-1\.0"),
    "cc-by": (("cc by", "cc-by", "cc- by", "creative commons attribution"), r"(?:cc(?:-\s*|\s+)by|creative\s+commons\s+attribution)(?!(?:-\s*|\s+)(?:(?:nc|sa|nd)(?![a-z])|non-?\s*commercial|share-?\s*alike|no-?\s*deriv))(?:\s*[1-4]\.[05])?", r"cc-by-[1-4]\.[05]"),
    "cc-by-sa": (("by-sa", "attribution"), r"(?:cc(?:-\s*|\s+)by-sa|creative\s+commons\s+attribution(?:-\s*|\s+)share-?\s*alike)(?:\s*[1-4]\.[05])?", r"cc-by-sa-[1-4]\.[05]"),
    "cc-by-nd": (("by-nd", "attribution"), r"(?:cc(?:-\s*|\s+)by-nd|creative\s+commons\s+attribution(?:-\s*|\s+)no-?\s*deriv\w*)(?:\s*[1-4]\.[05])?", r"cc-by-nd-[1-4]\.[05]"),
    "cc-by-nc": (("by-nc", "attribution"), r"(?:cc(?:-\s*|\s+)by-nc|creative\s+commons\s+attribution(?:-\s*|\s+)non-?\s*commercial)(?!(?:-\s*|\s+)(?:(?:sa|nd)(?![a-z])|share-?\s*alike|no-?\s*deriv))(?:\s*[1-4]\.[05])?", r"cc-by-nc-[1-4]\.[05]"),
    "cc-by-nc-sa": (("nc-sa", "attribution"), r"(?:cc(?:-\s*|\s+)by-nc-sa|creative\s+commons\s+attribution(?:-\s*|\s+)non-?\s*commercial(?:-\s*|\s+)share-?\s*alike)(?:\s*[1-4]\.[05])?", r"cc-by-nc-sa-[1-4]\.[05]"),
    "cc-by-nc-nd": (("nc-nd", "attribution"), r"(?:cc(?:-\s*|\s+)by-nc-nd|creative\s+commons\s+attribution(?:-\s*|\s+)non-?\s*commercial(?:-\s*|\s+)no-?\s*deriv\w*)(?:\s*[1-4]\.[05])?", r"cc-by-nc-nd-[1-4]\.[05]"),
}

#: How a family's name occurs: rule suffix, pattern around {name} or {id}, priority, confidence.
PHRASINGS: tuple[tuple[str, str, int, float], ...] = (
    ("tag", r"spdx-license-identifier:\s*(?:[\w.+-]+\s+(?:or|and)\s+)*{id}(?![\w.-])", 90, 1.0),
    ("grant", r"(?:licen[sc]ed|released|distributed|published|available|redistributed?)\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?{name}(?![\w-])(?:\s+licen[sc]e)?", 80, 0.95),
    ("named", r"(?<![\w-]){name}(?![\w-])\s+licen[sc]e(?!\w)", 60, 0.8),
    ("field", r"(?<!\w)licen[sc]e\s*[:=]\s*[\"']?(?:{name}|{id})(?![\w-])", 70, 0.9),
    ("link", r"https?://(?:www\.)?(?:opensource\.org/licen[sc]es?|spdx\.org/licen[sc]es)/{id}(?![\w-])", 85, 0.95),
)

#: Families whose name alone is evidence, without the word license next to it.
_ALONE = tuple(label for label, (_, name, _) in FAMILIES.items() if "licen" in name or label.startswith(("cc-", "cc0")))

#: Sentences of license bodies and notices.
SENTENCES: tuple[Rule, ...] = (
    Rule("mit-body", "mit", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person", ("hereby granted",), 75, 0.95),
    Rule("isc-body", "isc", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose", ("permission to use",), 75, 0.95),
    Rule("bsd-body", "bsd", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms", ("redistribution and use",), 75, 0.9),
    Rule("bsd-name", "bsd", r"(?<!\w)bsd(?:(?:-\s*|\s+)style)?\s+licen[sc]e", ("bsd",), 40, 0.7),
    Rule("apache-body", "apache-2.0", r"you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+licen[sc]e", ("in compliance with",), 75, 0.9),
    Rule("apache-link", "apache-2.0", r"https?://(?:www\.)?apache\.org/licen[sc]es/licen[sc]e-2\.0", ("apache.org",), 85, 1.0),
    Rule("apache-name", "apache", r"(?<!\w)apache(?:\s+software)?\s+licen[sc]e", ("apache",), 40, 0.7),
    Rule("gpl-body", "gpl", r"you\s+can\s+redistribute\s+it\s+and/or\s+modify\s+it\s+under\s+the\s+terms\s+of\s+the\s+gnu\s+general", ("redistribute it",), 75, 0.95),
    Rule("gpl-name", "gpl", r"(?<!\w)(?:gnu\s+)?general\s+public\s+licen[sc]e", ("general public",), 40, 0.8),
    Rule("gpl-short", "gpl", r"(?<!\w)(?:gnu\s+gpl|gplv[123])(?!\w)", ("gpl",), 40, 0.7),
    Rule("lgpl-name", "lgpl", r"(?<!\w)(?:gnu\s+)?(?:lesser|library)\s+general\s+public\s+licen[sc]e", ("lesser general", "library general"), 45, 0.8),
    Rule("gnu-link", "gpl", r"https?://(?:www\.)?gnu\.org/licen[sc]es/(?:old-licenses/)?gpl", ("gnu.org",), 85, 0.95),
    Rule("lgnu-link", "lgpl", r"https?://(?:www\.)?gnu\.org/licen[sc]es/(?:old-licenses/)?lgpl", ("gnu.org",), 85, 0.95),
    Rule("agnu-link", "agpl-3.0", r"https?://(?:www\.)?gnu\.org/licen[sc]es/agpl", ("gnu.org",), 85, 0.95),
    Rule("mpl-body", "mpl-2.0", r"this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla", ("source code form",), 75, 0.95),
    Rule("mpl-link", "mpl-2.0", r"https?://(?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0", ("mozilla.org",), 85, 0.95),
    Rule("epl-body", "epl", r"accompanying\s+materials\s+are\s+made\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse", ("accompanying materials",), 75, 0.95),
    Rule("boost-link", "boost-1.0", r"https?://(?:www\.)?boost\.org/licen[sc]e_1_0\.txt", ("boost.org",), 85, 0.95),
    Rule("unlicense-body", "unlicense", r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain", ("unencumbered",), 75, 0.95),
    Rule("zlib-body", "zlib", r"altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked\s+as\s+such", ("altered source",), 75, 0.9),
    Rule("cc-link", "cc", r"https?://(?:www\.)?creativecommons\.org/licen[sc]es/[a-z-]+/[1-4]\.[05]", ("creativecommons.org",), 84, 0.95),
    Rule("cc0-link", "cc0-1.0", r"https?://(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0", ("creativecommons.org",), 85, 0.95),
    Rule("cc-name", "cc", r"(?<!\w)creative\s+commons(?:\s+licen[sc]e)?", ("creative commons",), 30, 0.6),
    Rule("public-domain", "public-domain", r"(?<!\w)(?:released\s+(?:in)?to|placed\s+in|dedicated\s+to|in)\s+the\s+public\s+domain", ("public domain",), 50, 0.7),
    Rule("reserved", "reserved", r"(?<!\w)(?:all|some|no)\s+rights\s+reserved", ("rights reserved",), 50, 0.8),
    Rule("reserved-fr", "reserved", r"(?<!\w)tous\s+droits\s+r\S{1,2}serv\S{1,2}s", ("tous droits",), 50, 0.8),
    Rule("reserved-de", "reserved", r"(?<!\w)alle\s+rechte\s+vorbehalten", ("alle rechte",), 50, 0.8),
    Rule("reserved-es", "reserved", r"(?<!\w)todos\s+los\s+derechos\s+reservados", ("todos los derechos",), 50, 0.8),
    Rule("copyright", "copyright", r"(?<!\w)copyright\s+(?:\(c\)|©)?\s*(?:19|20)\d\d", ("copyright",), 35, 0.6),
    Rule("copyright-sign", "copyright", r"(?:\(c\)|©)\s*(?:copyright\s+)?(?:19|20)\d\d", ("(c)", "©"), 35, 0.5),
    Rule("as-is", "no-warranty", r"(?:provided|distributed)\s+[\"“']?as\s+is[\"”']?,?\s+without\s+(?:any\s+)?warrant", ("warrant",), 55, 0.7),
    Rule("no-warranty", "no-warranty", r"without\s+any\s+warranty;\s+without\s+even\s+the\s+implied\s+warranty", ("implied warranty",), 55, 0.8),
    Rule("confidential", "proprietary", r"(?<!\w)(?:proprietary\s+and\s+confidential|confidential\s+and\s+proprietary)", ("proprietary",), 55, 0.8),
    Rule("no-reproduction", "proprietary", r"(?<!\w)(?:may\s+not\s+be|no\s+part\s+of\s+this\s+\w+\s+may\s+be)\s+(?:reproduced|copied)", ("reproduced", "copied"), 55, 0.7),
    Rule("non-commercial", "non-commercial", r"(?<!\w)for\s+(?:non-?\s*commercial|personal|educational)\s+use\s+only", ("use only",), 45, 0.6),
)


def standard_rules() -> tuple[Rule, ...]:
    """All signature rules: each family under each phrasing, names that stand alone, and sentences."""
    rules = list(SENTENCES)
    for label, (keywords, name, identifier) in FAMILIES.items():
        for suffix, pattern, priority, confidence in PHRASINGS:
            gate = keywords if suffix != "tag" else ("spdx-license-identifier",)
            gate = ("opensource.org", "spdx.org") if suffix == "link" else gate
            rules.append(Rule(f"{label}-{suffix}", label, pattern.format(name=name, id=identifier), gate, priority, confidence))
        if label in _ALONE:
            rules.append(Rule(f"{label}-alone", label, rf"(?<![\w-]){name}(?![\w-])", keywords, 50, 0.75))
    return tuple(rules)


#: The base phrases, as words, and their labels.
BASE_PHRASES: tuple[tuple[str, str], ...] = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)


def uncontained(found: list[tuple[Rule, int, int]]) -> list[tuple[Rule, int, int]]:
    """Of (rule, start, end) in order of precedence, those that no kept one before them contains.

    The greatest end kept so far is known for every prefix of the starts, in a tree of sums'
    shape, so a text with n detections takes n log n steps.
    """
    starts = {start: i for i, start in enumerate(sorted({start for _, start, _ in found}), 1)}
    ends = [-1] * (len(starts) + 1)
    kept = []
    for rule, start, end in found:
        at, furthest = starts[start], -1
        while at:
            furthest = max(furthest, ends[at])
            at &= at - 1
        if furthest >= end:
            continue
        kept.append((rule, start, end))
        at = starts[start]
        while at < len(ends):
            ends[at] = max(ends[at], end)
            at += at & -at
    return kept


class Scanner:
    """Gate and compiled rules of one worker process."""

    def __init__(self, rules: tuple[Rule, ...], base: tuple[tuple[str, str], ...]) -> None:
        import ahocorasick

        self.rules = [(rule, re.compile(rule.pattern)) for rule in rules]
        gates: dict[str, set[int]] = {}
        for i, rule in enumerate(rules):
            for keyword in rule.keywords:
                gates.setdefault(keyword, set()).add(i)
        self.gate = ahocorasick.Automaton()
        for keyword, opened in gates.items():
            self.gate.add_word(keyword, opened)
        self.gate.make_automaton()
        word, gap = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]+"
        self.base = [(max(phrase.split(), key=len).encode(), re.compile(rb"(?<!" + word + rb")(?=" + gap.join(map(re.escape, phrase.encode().split())) + rb"(?!" + word + rb"))"), label) for phrase, label in base]

    def opened(self, lowered: str) -> list[int]:
        """Places of the rules to try; keywords of several words stand apart by one space, while patterns take any white space."""
        return sorted(set().union(*(indices for _, indices in self.gate.iter(" ".join(lowered.split())))))

    def detections(self, lowered: str) -> list[tuple[str, str, int, int, float]]:
        """(label, rule, start, end, confidence) of the detections that no other contains, by start."""
        found = [(rule, m.start(), m.end()) for i in self.opened(lowered) for rule, pattern in [self.rules[i]] for m in pattern.finditer(lowered) if m.end() > m.start()]
        found.sort(key=lambda x: (-x[0].priority, x[1] - x[2], x[1], x[0].name))
        return [(rule.label, rule.name, start, end, rule.confidence) for rule, start, end in sorted(uncontained(found), key=lambda x: x[1:])]

    def base_places(self, lowered: bytes) -> list[tuple[int, str]]:
        """(byte offset, label) of every place where a base phrase stands."""
        return [(m.start(), label) for rare, pattern, label in self.base if rare in lowered for m in pattern.finditer(lowered)]


@lru_cache(maxsize=2)
def scanner(rules: tuple[Rule, ...], base: tuple[tuple[str, str], ...]) -> Scanner:
    """The worker process's scanner."""
    return Scanner(rules, base)


def scan_licenses(docs: DataFrame, rules: tuple[Rule, ...] | None = None, base: tuple[tuple[str, str], ...] = BASE_PHRASES) -> DataFrame:
    """doc_id, n_words, places (word, label) of base phrases, and detections of the rules.

    docs: needs doc_id and text; other columns are ignored. A-Z are lower-cased; a word is a run
    of digits, a-z and characters beyond ASCII. places: every start of a base phrase, in order.
    detections: (label, rule, start, end, confidence), in characters, by start; of equal ones
    the first rule by name. Null texts count as empty: no words, places or detections. Repeated
    rows are answered each for itself, an empty table gives no rows, texts are read whole.
    """
    rules = standard_rules() if rules is None else tuple(rules)
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    detection = pa.struct([("label", pa.string()), ("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("confidence", pa.float64())])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = scanner(rules, base), byte_class(SEPARATORS)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            counts, places, detections = [], [], []
            for first, end in chunks(offsets):
                raw = data[offsets[first] : offsets[end]].tobytes().lower()
                at = offsets[first : end + 1] - offsets[first]
                starts, _, before = runs(words[np.frombuffer(raw, np.uint8)], at)
                counts.append(np.diff(before))
                for i in range(end - first):
                    text = raw[at[i] : at[i + 1]]
                    own_starts = starts[before[i] : before[i + 1]] - at[i]
                    found = sorted(own.base_places(text))
                    places.append([{"word": int(np.searchsorted(own_starts, byte)), "label": label} for byte, label in found])
                    detections.append([dict(zip(("label", "rule", "start", "end", "confidence"), x)) for x in own.detections(text.decode("utf-8", "replace"))])
            n_words = pa.array(np.concatenate(counts) if counts else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_words, pa.array(places, pa.list_(place)), pa.array(detections, pa.list_(detection))], ["doc_id", "n_words", "places", "detections"])

    schema = "doc_id long, n_words long, places array<struct<word:long,label:string>>, detections array<struct<label:string,rule:string,start:long,end:long,confidence:double>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scanned, schema)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document: base phrases and the labels of the signature rules."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.array_sort(F.array_distinct("places.label"))
    labels = F.array_sort(F.array_distinct(F.concat("places.label", "detections.label")))
    missed = F.aggregate("detections.confidence", F.lit(1.0), lambda left, confidence: left * (1 - confidence))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(1 - missed)
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )
