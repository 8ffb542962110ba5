"""5. License scans by sentence rules.

A text is split into sentences (at line ends of blank lines, and after . ; ! ? and white space, but not within 'v. 2'), each is normalised (lower
case, white space, quotes and comment marks folded, punctuation at the ends dropped), and each sentence is mapped to the
licence-sentence identifiers of the known wordings that it holds, in their order; of wordings that overlap the first in the
table counts. A sentence that comes again is looked up, not read again. The sequence of identifiers of a text is then matched against ordered rules: a rule
is a sequence of identifiers for one licence; at each place the first rule that fits wins and takes its identifiers. What
no rule takes, but speaks of a licence, is reported as ``unknown``.

A cheap pattern search skips texts and sentences that contain none of the cue words of the known sentences.

Edge cases: a null or empty text, or one without known sentences, has no identifiers and no licences; repeated
sentences count each, and licences are reported once; an empty table gives no rows. Extra columns stay in
``scan_licenses``; ``sentences licenses n_sentences`` overwrite columns of these names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A text without any of these has no known sentence: each wording holds one. Single words, as line ends and comment marks may stand between two. Fixed values.
CUES = r"(?i)licen[cs]|copyright|redistribut|permission|warrant|domain|spdx|commons|\bcc|bsd|endorse|advertising|misrepresented|reserved"

#: Licence-sentence identifiers and their wordings in normalised sentences. Fixed values.
SENTENCES = (
    ("SpdxLine", r"spdx-license-identifier: ?(?P<name>[a-z0-9.+-]+)"),
    ("ApacheRef2", r"licensed under the apache licen[cs]e,? ?(?:version|v) ?2(?:\.0)?"),
    ("ApacheCompliance", r"you may not use this (?:file|work|software) except in compliance with the licen[cs]e"),
    ("ApacheCopy", r"you may obtain a copy of the licen[cs]e at"),
    ("ApacheWarranty", r"unless required by applicable law or agreed to in writing,? software distributed under the licen[cs]e is distributed on an \"?as is\"? basis"),
    ("ApacheLanguage", r"see the licen[cs]e for the specific language governing permissions and limitations"),
    ("AffermoRef3", r"gnu affero general public licen[cs]e,? (?:version|v) ?3"),
    ("LesserRef3", r"gnu lesser general public licen[cs]e,? (?:version|v) ?3"),
    ("LesserRef21", r"gnu lesser general public licen[cs]e,? (?:version|v) ?2\.1"),
    ("LibraryRef2", r"gnu library general public licen[cs]e,? (?:version|v) ?2"),
    ("GplRef3Later", r"gnu general public licen[cs]e.*(?:version|v) ?3.*or (?:\(at your option\) )?any later version"),
    ("GplRef2Later", r"gnu general public licen[cs]e.*(?:version|v) ?2.*or (?:\(at your option\) )?any later version"),
    ("GplRef3", r"gnu general public licen[cs]e,? (?:version|v) ?3"),
    ("GplRef2", r"gnu general public licen[cs]e,? (?:version|v) ?2"),
    ("GplTerms", r"redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("GplHope", r"distributed in the hope that it will be useful,? but without any warranty"),
    ("GplReceived", r"you should have received a copy of the gnu (?:\w+ )?general public licen[cs]e"),
    ("GplAny", r"gnu general public licen[cs]e"),
    ("MitName", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?(?:mit|expat)(?: \(?x11\)?)? licen[cs]e"),
    ("MitGrant", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software"),
    ("MitNotice", r"above copyright notice and this permission notice shall be included"),
    ("MitWarranty", r"the software is provided \"?as is\"?,? without warranty of any kind"),
    ("MitLiability", r"in no event shall the authors or copyright holders be liable"),
    ("IscGrant", r"permission to use,? copy,? modify,? and(?:/or)? distribute this software for any purpose"),
    ("IscWarranty", r"the software is provided \"?as is\"? and the author disclaims all warranties"),
    ("BsdName3", r"under (?:the|a) (?:3-clause|new|modified) bsd"),
    ("BsdName2", r"under (?:the|a) (?:2-clause|simplified) bsd"),
    ("BsdGrant", r"redistribution and use in source and binary forms,? with or without modification,? are permitted"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BsdEndorse", r"may be used to endorse or promote products derived from this software"),
    ("BsdAdvert", r"all advertising materials mentioning features or use of this software must display"),
    ("BsdWarranty", r"this software is provided by the .* \"?as is\"? and any express or implied warranties"),
    ("MozillaRef2", r"mozilla public licen[cs]e,? (?:version|v\.?) ?2(?:\.0)?"),
    ("EclipseRef2", r"eclipse public licen[cs]e,? (?:-|version|v\.?)? ?2(?:\.0)?"),
    ("EclipseRef1", r"eclipse public licen[cs]e,? (?:-|version|v\.?)? ?1(?:\.0)?"),
    ("CcByNcSa", r"(?:\bcc[ -]by-nc-sa|creative commons attribution-?non-?commercial-?share-?alike)[ -]?(?P<name>[0-9.]*)"),
    ("CcByNcNd", r"(?:\bcc[ -]by-nc-nd|creative commons attribution-?non-?commercial-?no-?deriv\w*)[ -]?(?P<name>[0-9.]*)"),
    ("CcByNc", r"(?:\bcc[ -]by-nc|creative commons attribution-?non-?commercial)[ -]?(?P<name>[0-9.]*)"),
    ("CcBySa", r"(?:\bcc[ -]by-sa|creative commons attribution-?share-?alike)[ -]?(?P<name>[0-9.]*)"),
    ("CcByNd", r"(?:\bcc[ -]by-nd|creative commons attribution-?no-?deriv\w*)[ -]?(?P<name>[0-9.]*)"),
    ("CcBy", r"(?:\bcc[ -]by|creative commons attribution)[ -]?(?P<name>[0-9.]*)"),
    ("CcZero", r"\bcc0\b|creative commons zero"),
    ("UnlicenseGrant", r"free and unencumbered software released into the public domain"),
    ("PublicDomain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("SpdxChoice", r"(?:(?<= or )|(?<= and ))(?P<name>(?:mit|apache-2\.0|bsd-[234]-clause|isc|mpl-2\.0|l?gpl-[23]\.[01](?:-only|-or-later)?))(?![\w-])"),
    ("ApacheBare", r"\bapache licen[cs]e,? ?(?:version|v) ?2(?:\.0)?"),
    ("MitBare", r"\b(?:mit|expat) licen[cs]e"),
    ("BoostRef", r"boost software licen[cs]e"),
    ("ZlibWarranty", r"this software is provided \"?as-is\"?,? without any express or implied warranty"),
    ("ZlibOrigin", r"the origin of this software must not be misrepresented"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"copyright (?:\(c\)|©)? ?[0-9]{4}"),
    ("SomeLicense", r"licen[cs]ed under|under the terms of the .*licen[cs]e|subject to the .*licen[cs]e"),
)

#: Ordered rules: licence, then the identifiers in their order. Identifiers in brackets may be missing. Fixed values.
RULES = (
    ("Apache-2.0", "ApacheRef2 [ApacheCompliance] [ApacheCopy] [ApacheWarranty] [ApacheLanguage]"),
    ("Apache-2.0", "ApacheCompliance ApacheCopy [ApacheWarranty] [ApacheLanguage]"),
    ("AGPL-3.0", "AffermoRef3 [GplHope] [GplReceived]"),
    ("LGPL-3.0", "LesserRef3 [GplHope] [GplReceived]"),
    ("LGPL-2.1", "LesserRef21 [GplHope] [GplReceived]"),
    ("LGPL-2.0", "LibraryRef2 [GplHope] [GplReceived]"),
    ("GPL-3.0-or-later", "GplRef3Later [GplHope] [GplReceived]"),
    ("GPL-2.0-or-later", "GplRef2Later [GplHope] [GplReceived]"),
    ("GPL-3.0", "GplRef3 [GplHope] [GplReceived]"),
    ("GPL-2.0", "GplRef2 [GplHope] [GplReceived]"),
    ("GPL", "GplTerms [GplHope] [GplReceived]"),
    ("GPL", "GplAny [GplHope] [GplReceived]"),
    ("MIT", "[Copyright] [AllRights] MitGrant MitNotice [MitWarranty] [MitLiability]"),
    ("MIT", "MitName"),
    ("ISC", "[Copyright] [AllRights] IscGrant [IscWarranty]"),
    ("BSD-4-Clause", "[Copyright] [AllRights] BsdGrant BsdSource BsdBinary BsdAdvert [BsdEndorse] [BsdWarranty]"),
    ("BSD-3-Clause", "[Copyright] [AllRights] BsdGrant BsdSource BsdBinary BsdEndorse [BsdWarranty]"),
    ("BSD-2-Clause", "[Copyright] [AllRights] BsdGrant BsdSource BsdBinary [BsdWarranty]"),
    ("BSD-3-Clause", "BsdName3"),
    ("BSD-2-Clause", "BsdName2"),
    ("MPL-2.0", "MozillaRef2"),
    ("EPL-2.0", "EclipseRef2"),
    ("EPL-1.0", "EclipseRef1"),
    ("CC-BY-NC-SA", "CcByNcSa"),
    ("CC-BY-NC-ND", "CcByNcNd"),
    ("CC-BY-NC", "CcByNc"),
    ("CC-BY-SA", "CcBySa"),
    ("CC-BY-ND", "CcByNd"),
    ("CC-BY", "CcBy"),
    ("CC0-1.0", "CcZero"),
    ("Unlicense", "UnlicenseGrant"),
    ("BSL-1.0", "BoostRef"),
    ("Zlib", "[Copyright] [AllRights] ZlibWarranty ZlibOrigin"),
    ("public-domain", "PublicDomain"),
    ("Apache-2.0", "ApacheBare"),
    ("MIT", "MitBare"),
    ("spdx", "SpdxLine"),
    ("spdx", "SpdxChoice"),
    ("proprietary", "[Copyright] AllRights"),
    ("unknown", "SomeLicense"),
    ("unknown", "MitGrant"),
    ("unknown", "BsdGrant"),
    ("unknown", "ZlibWarranty"),
    ("unknown", "ApacheCompliance"),
)

_MARKS = re.compile(r"^[\s/*#;%!>-]+", re.M)
_SPLIT = re.compile(r"\n\s*\n|(?<=[.;!?])(?<![\s,][vV]\.)\s+|\s+\|\s+")
_SPACE = re.compile(r"\s+")
_QUOTES = re.compile("[\"'`\u2018\u2019\u201c\u201d]+")
_KNOWN = [(name, re.compile(wording)) for name, wording in SENTENCES]
_STEPS = [(name, [(x.strip("[]"), x[0] == "[") for x in rule.split()]) for name, rule in RULES]


def normalise(text: str) -> list[str]:
    """The normalised sentences of a text that hold a cue word."""
    text = _MARKS.sub("", text)
    found = (_QUOTES.sub('"', _SPACE.sub(" ", s)).strip(" .,;:!?*#/").lower() for s in _SPLIT.split(text))
    return [s for s in found if s and re.search(CUES, s)]


@functools.lru_cache(1 << 16)
def identify(sentence: str) -> tuple[str, ...]:
    """The identifiers of the wordings that the sentence has, by place; a version or name that one gives follows a colon."""
    taken: list[tuple[int, int, str]] = []
    for name, wording in _KNOWN:
        if name == "SomeLicense" and taken:  # only where nothing else is known
            break
        for m in wording.finditer(sentence):
            if all(m.end() <= a or b <= m.start() for a, b, _ in taken):
                more = (m.groupdict().get("name") or "").strip(".")
                taken.append((m.start(), m.end(), f"{name}:{more}" if more else name))
    return tuple(x for _, _, x in sorted(taken))


def match_rules(ids: list[str]) -> list[str]:
    """Licences in the order of the text: at each place the first rule that fits takes its identifiers."""
    out, at = [], 0
    while at < len(ids):
        for licence, steps in _STEPS:
            to, more = at, ""
            for want, optional in steps:
                if to < len(ids) and ids[to].partition(":")[0] == want:
                    more = more or ids[to].partition(":")[2]
                    to += 1
                elif not optional:
                    break
            else:
                if to > at:
                    out.append(more if licence == "spdx" else f"{licence}-{more}" if more else licence)
                    at = to
                    break
        else:
            at += 1
    return out


def scan_text(text: str | None) -> tuple[list[str], list[str]]:
    """The identifiers and the different licences of a text, both in its order."""
    ids = [x for s in normalise(text or "") for x in identify(s)]
    return ids, list(dict.fromkeys(match_rules(ids)))


def scan_licenses(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """docs (or their columns keep) with sentences (identifiers), licenses, and n_sentences."""
    added = ("sentences", "licenses", "n_sentences")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    schema = docs.select(*keep).schema.add("sentences", T.ArrayType(T.StringType())).add("licenses", T.ArrayType(T.StringType())).add("n_sentences", "long")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(keep))
            cue = pc.fill_null(pc.match_substring_regex(text, CUES), False)
            found = [scan_text(t.as_py()) if c else ([], []) for t, c in zip(text, cue.to_pylist(), strict=True)]
            lists = [pa.array([x[i] for x in found], pa.list_(pa.string())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *lists, pa.array([len(x[0]) for x in found], pa.int64())], schema.names)

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(of, schema)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", "n_sentences", F.concat_ws(",", "sentences").alias("sentences"), F.concat_ws(",", "licenses").alias("licenses"))


QUERIES = {"op5_licenses": (op5_licenses, None)}
