"""Cases that an earlier round did only in part."""

import random
import re
import string
import textwrap

import pandas as pd
from pyspark.sql import functions as F

from rxlink.llm import license_scan, near_dedup, secrets_scan
from rxlink.operators import mapping

DOCS = "doc_id long, text string"


# --- 3 and the pipeline: near dedup at other thresholds


def pair_with_similarity(seed, low, high, n=400):
    """Two texts whose five-word shingle sets have a similarity in [low, high)."""
    rng = random.Random(seed)
    one = [f"p{seed}w{i}" for i in range(n)]
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    while True:
        two = list(one)
        for i in rng.sample(range(n), rng.randrange(5, 14)):
            two[i] = f"e{rng.randrange(10**9)}"
        a, b = sets(one), sets(two)
        if low <= len(a & b) / len(a | b) < high:
            return " ".join(one), " ".join(two)


def test_bands_fit_the_threshold():
    for per_cent in (95, 85, 80, 70, 50):
        rows, bands = near_dedup.layout(per_cent)
        assert rows * bands == near_dedup.REGISTERS
        assert (1 - (per_cent / 100) ** rows) ** bands <= 1e-6
    assert near_dedup.layout(85) == (8, 48) and near_dedup.layout(80) == (6, 64)


def test_pipeline_stage_drops_copies_from_080(spark):
    import corpus_pipeline

    rows, gone = [], set()
    for k in range(60):
        inside = k % 3 > 0
        one, two = pair_with_similarity(k, *((0.80, 0.85) if inside else (0.74, 0.795)))
        rows += [(2 * k, one, "en", "s", len(one)), (2 * k + 1, two, "en", "s", len(two))]
        gone |= {2 * k + 1} if inside else set()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()}
    assert {r[0] for r in rows} - kept == gone


# --- 6: licences wrapped over lines, inside lines and in files

MIT_FILE = f"""MIT License

Copyright (c) 2021 Somebody

{license_scan.TEMPLATES["MIT-grant"]}

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def wrapped(text, lead=""):
    return "\n".join(textwrap.fill(x, 78 - len(lead), initial_indent=lead, subsequent_indent=lead) for x in text.split("\n"))


def window_by_hand(t):
    """The best window of all, by trying every run of words."""
    w = re.findall("[a-z0-9]+", t.lower())
    g, best = list(zip(w, w[1:])), 0.0
    for text in (license_scan.TEMPLATES | license_scan.TEXTS).values():
        v = re.findall("[a-z0-9]+", text.lower())
        own = set(zip(v, v[1:]))
        for a in range(len(g)):
            for m in range(1, min(len(g) - a, int(len(own) * 1.5)) + 1):
                s = set(g[a : a + m])
                best = max(best, 2 * len(s & own) / (len(s) + len(own)))
    return round(best, 6) if best >= license_scan.DICE - 1e-12 else 0.0


def test_licenses_in_windows(spark):
    apache = license_scan.TEMPLATES["Apache-2.0-header"]
    rows = [
        (1, wrapped(MIT_FILE), "MIT-grant", 1.0, 5), (2, MIT_FILE.replace("\n", " "), "MIT-grant", 1.0, 1), (3, f"int x;\n{wrapped(apache, '# ')}\nint y;", "Apache-2.0-header", 1.0, 2),
        (4, "All is described in the manual. Released under the MIT License. See the wiki for more.", "MIT", 1.0, 1), (5, "a b c\nis Released under\nthe MIT\nLicense and so on and on", "MIT", 1.0, 2),
        (6, wrapped(license_scan.TEXTS["CC-BY-4.0-text"]) + "\nSection 1 - Definitions.", "CC-BY-4.0-text", 1.0, 1), (7, "the license of the software and the manual under which it is released", None, 0.0, -1),
    ]
    changed = [(10, "so " + apache.replace("may not", "must never") + " ok"), (11, "x Released under the the MIT License y z"), (12, wrapped(apache.replace("Version", "v")) + "\ntail words"), (13, "Released under MIT MIT License now")]
    b = F.col("__ls_best")
    got = license_scan.scan_licenses(spark.createDataFrame([r[:2] for r in rows] + changed, DOCS))
    got = {r[0]: tuple(r)[1:] for r in got.select("doc_id", b["license"], F.round(F.coalesce(b["dice"], F.lit(0.0)), 6), F.coalesce(b["unit"], F.lit(-1))).collect()}
    assert {r[0]: got[r[0]] for r in rows} == {r[0]: r[2:] for r in rows}
    assert {d: got[d][1] for d, _ in changed} == {d: window_by_hand(t) for d, t in changed}


# --- 5: secrets that allow-list rules took for words, paths and placeholders


def test_secrets_that_look_like_no_word(spark):
    rng = random.Random(3)
    letters, base64 = string.ascii_letters, string.ascii_letters + string.digits + "+/"
    made = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    keys = [k for k in (made(base64, 40) for _ in range(900)) if "/" in k][:300]
    tokens = [made(letters, rng.randrange(20, 41)) for _ in range(300)]
    blobs = [made(base64, 60) + w + made(base64, 60) for w in ("xxxx", "sample", "Dummy") for _ in range(20)]
    clean = [
        "path/to/some/long/dir/file", "src/main/java/Engine2/RecordPlan", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "getUserNameFromRecordPlan", "some_long_identifier_of_words", "your-api-key-placeholder-12345",
        "x" * 24 + "Ab3", "/usr/share/common/licenses/",
    ]
    rows = list(enumerate(keys + tokens + blobs + clean))
    got = dict(secrets_scan.scan_secrets(spark.createDataFrame(rows, DOCS)).select("doc_id", secrets_scan.spelled(F.col("__ss_spans"))).collect())
    found = [got[i] == f"entropy:0:{len(t)}" for i, t in rows]
    assert sum(found[:300]) >= 295 and sum(found[300:600]) >= 270 and all(found[600:660])
    assert not any(got[i] for i, _ in rows[660:])


# --- mapping: lopsided problems


def test_lopsided_problem_is_solved():
    n = 6_000
    rng = random.Random(1)
    rows = [(f"i{r:05}", k, rng.random(), r, j) for r in range(n) for j, k in enumerate("abc")]
    group = pd.DataFrame(rows, columns=["image_name", "medicine_unique_key", "assignment_score", "strip_row", "record_row"])
    pairs = mapping.solve(group)
    best = group.groupby("medicine_unique_key")["assignment_score"].max().sum()
    got = pairs.merge(group, on=["image_name", "medicine_unique_key"])
    assert len(got) == 3 and got["image_name"].is_unique and abs(got["assignment_score"].sum() - best) < 1e-9  # the three best rows differ
