"""Licence scan: canonical form, digest, hash join with the digests of known licence texts."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsieve.llm.common import held, packed, salted_join, stored, unpacked

# Spellings that the licence matching guidelines treat as equal.
EQUIVALENT = [
    ("acknowledgment", "acknowledgement"), ("analog", "analogue"), ("analyze", "analyse"), ("artifact", "artefact"),
    ("authorization", "authorisation"), ("authorized", "authorised"), ("caliber", "calibre"), ("canceled", "cancelled"),
    ("capitalizations", "capitalisations"), ("catalog", "catalogue"), ("categorize", "categorise"), ("center", "centre"),
("emphasized", "emphasised"), ("favor", "favour"), ("favorite", "favourite"),
    ("fulfill", "fulfil"), ("fulfillment", "fulfilment"), ("initialize", "initialise"), ("judgment", "judgement"),
    ("labeling", "labelling"), ("labor", "labour"), ("license", "licence"), ("licensed", "licenced"),
    ("maximize", "maximise"), ("modeled", "modelled"), ("modeling", "modelling"), ("noncommercial", "non commercial"),
    ("offense", "offence"), ("optimize", "optimise"), ("organization", "organisation"), ("organize", "organise"),
    ("percent", "per cent"), ("practice", "practise"), ("program", "programme"), ("realize", "realise"),
    ("recognize", "recognise"), ("signaling", "signalling"), ("sublicense", "sublicence"), ("utilization", "utilisation"),
    ("while", "whilst"), ("wilfull", "wilful"),
]

# Pairs of words, after the words above.
EQUIVALENT_PAIRS = [("copyright holder", "copyright owner"), ("sub licence", "sublicence")]

# Titles above licence texts, in canonical form.
TITLES = [
    "mit licence", "the mit licence", "the mit licence mit", "mit licence mit", "isc licence", "the isc licence", "isc licence isc",
    "bsd zero clause licence", "zero clause bsd licence", "bsd 2 clause licence", "the bsd 2 clause licence", "simplified bsd licence",
    "bsd 3 clause licence", "the bsd 3 clause licence", "new bsd licence", "modified bsd licence", "zlib licence", "the zlib licence",
    "boost software licence version 1 0 august 17th 2003", "unlicense", "the unlicense",
]

# Texts of short licences and the usual notices of long ones.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
]

COPYRIGHT_LINE = r"^[^\p{L}\p{N}©]*(?:copyright(?: \(c\)| ©|,)? [0-9]|copyright (?:\(c\)|©)|copyright by |\(c\) |© |all rights reserved)"
EMPTY = sha256(b"").hexdigest()
MARKS = r"[^\p{L}\p{N}]+"
LISTED = "(?<![^ ])(?:" + "|".join(a for a, _ in EQUIVALENT) + ")(?![^ ])"


def paired(words: Column) -> Column:
    for a, b in EQUIVALENT_PAIRS:
        words = F.regexp_replace(words, f"(?<![^ ]){a}(?![^ ])", b)
    return words


def with_digests(rows: DataFrame, text: str) -> DataFrame:
    """`rows` with text_digest (of the entire text) and line_digests (of its lines), from one canonical form per line.

    A line's canonical form is lower case, marks as single blanks, one spelling per word; copyright lines are empty. The text's
    is that of its lines, without the titles and lines that start with "copyright" ahead of all others. NULL for NULL and for
    texts without a letter or digit.
    """
    spelling = F.create_map(*[F.lit(w) for pair in EQUIVALENT for w in pair])
    plain = lambda x: F.btrim(F.regexp_replace(x, MARKS, " "), F.lit(" "))
    rows = held(rows, lowered=F.split(F.lower(F.col(text)), "\n"))
    rows = held(rows, plain=F.transform("lowered", lambda x: F.when(x.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(plain(x))))
    one = lambda x: F.array_join(F.transform(F.split(x, " "), lambda w: F.coalesce(F.try_element_at(spelling, w), w)), " ")
    canon = F.transform("plain", lambda x: F.when(x.rlike(LISTED), one(x)).otherwise(x))
    rows = held(rows, canon=F.filter(canon, lambda x: x != ""))
    above = lambda x: x.isin([*TITLES, "copyright"]) | x.startswith("copyright ")
    rows = held(rows, first=F.array_position(F.transform("canon", lambda x: ~above(x)), True))
    whole = F.array_join(F.slice("canon", F.greatest("first", F.lit(1)).cast("int"), F.greatest(F.size("canon"), F.lit(1))), " ")
    rows = held(
        rows, text_digest=F.nullif(F.sha2(paired(whole), 256), F.lit(EMPTY)),
        line_digests=F.transform(F.array_distinct("canon"), lambda x: F.sha2(paired(x), 256)),
    )
    return rows.drop("lowered", "plain", "canon", "first")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """One row per digest of known licence texts (license_id, text); of equal texts the smallest id."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(known, "license_id string, text string")
    rows = with_digests(rows.select("license_id", "text"), "text").withColumnRenamed("text_digest", "digest")
    return rows.where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the text, with text_digest, license_id (of the entire text) and notice_ids (of the text and of lines
    that are entire known texts).

    Every row stays, repeated ones too. NULL, empty and mark-only texts have no digest and no licence. notice_ids is
    sorted and without repeats. `known` has one row per digest (`known_digests`). Columns of `docs` called like the new
    ones are replaced. Digests are made once and stored; texts of equal digests are looked up once. A licence that a third of
    all texts carries, and a text that a third of all rows repeat, are spread over tasks by a salt.
    """
    new = ("text_digest", "license_id", "notice_ids")
    rows = with_digests(packed(docs, (*new, text), text=F.col(f"`{text}`")), "text").drop("text")
    rows = rows.withColumn("key", F.xxhash64(F.to_json("row")))
    rows = rows.withColumn("held", F.xxhash64("text_digest", "line_digests"))
    rows = stored(rows, "license-digests")
    asked = F.array_union(F.array("text_digest"), F.coalesce("line_digests", F.array().cast("array<string>")))
    asked = rows.select("text_digest", "held", F.explode(asked).alias("digest")).where("digest is not null")
    hits = salted_join(asked, known, ["digest"], F.col("held"), "inner")
    per_text = hits.groupBy("held").agg(
        F.min(F.when(F.col("digest") == F.col("text_digest"), F.col("license_id"))).alias("license_id"),
        F.array_sort(F.collect_set("license_id")).alias("notice_ids"),
    )
    joined = salted_join(rows.drop("line_digests"), per_text, ["held"], F.col("key"), "left")
    joined = joined.withColumn("notice_ids", F.coalesce("notice_ids", F.array().cast("array<string>")))
    return unpacked(joined, *new)
