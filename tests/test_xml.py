"""XML decoding rules and the file reader."""

import os

from litsearch.sources.xml import decode_article, decoded_slices, ingest

ART = """<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-meta>
<article-id pub-id-type="pmc">PMC1</article-id><article-id pub-id-type="other">z</article-id>
<article-id pub-id-type="pmc">PMC2</article-id><article-id pub-id-type="doi">10.1/x</article-id>
<title-group><article-title>Role of <italic>E. coli</italic> in gut &amp; more</article-title></title-group>
<contrib-group>
 <contrib><name><surname>First</surname><given-names>Given</given-names></name></contrib>
 <contrib><name><surname>Last</surname></name></contrib>
</contrib-group>
<pub-date><year>1999</year></pub-date><pub-date><year>2001</year></pub-date>
<abstract><p>&#160;One <b>bold</b> two &lt;3</p><sec><p>nested</p></sec><p>T</p></abstract>
<kwd-group><kwd>a</kwd><kwd> b </kwd></kwd-group><kwd-group><kwd>a</kwd></kwd-group>
</article-meta></front><body><p>x</p></body></article>"""


def test_rules():
    a = decode_article(ART)
    assert a["ok"]
    assert a["article_title"] == "Role of  in gut & more"
    assert a["abstract_p"] == [" One  two <3", "T"]
    assert a["kwd"] == ["a", " b ", "a"]
    assert a["surname"] == "Last" and a["given_names"] == "Given"
    assert a["year"] == "2001"
    assert list(zip(a["id_values"], a["id_types"]))[2] == ("PMC2", "pmc")


def test_structured_abstract_only_is_empty():
    a = decode_article("<article><front><article-meta><abstract><sec><p>x</p></sec></abstract>"
                       "</article-meta></front></article>")
    assert a["abstract_p"] == [] and a["kwd"] == [] and a["surname"] is None


def test_namespaced_article():
    a = decode_article('<article xmlns="http://jats.nlm.nih.gov"><front><article-meta>'
                       '<title-group><article-title>T</article-title></title-group>'
                       '</article-meta></front></article>')
    assert a["article_title"] == "T"


def test_rejects():
    assert decode_article("<article><front>")["error"] == "truncated"
    assert decode_article("<article><front>&nbsp;</front></article>")["error"] == "undefined_entity"
    assert decode_article("<article><front></article>")["error"] == "mismatched_tag"


def test_reader_splits_records(spark, tmp_path):
    body = ("<pmc-articleset>" + ART.replace("\n", " ")
            + "<article><front><article-meta><title-group><article-title>S</article-title>"
              "</title-group></article-meta></front><sub-article><front></front></sub-article>"
              "</article>"
            + "<article><front>broken</article></pmc-articleset>")
    p = tmp_path / "a.xml"
    p.write_text(body)
    papers, rejects = ingest(spark, os.fspath(tmp_path))
    rows = sorted(papers.collect(), key=lambda r: r.article_title)
    assert [r.article_title for r in rows] == ["Role of  in gut & more", "S"]
    first = rows[0]
    assert first.abstract == "One  two <3\nT"     # trimmed incl. the no-break space
    assert first.pmc_id == "PMC2" and first.url.endswith("/PMC2/")
    assert first.author == "Last Given" and first.pub_year == "2001"
    assert rows[1].author == " " and rows[1].keywords == [] and rows[1].pmc_id == ""
    assert rows[1].url.endswith("/PMC/")
    assert [r.error for r in rejects.collect()] == ["mismatched_tag"]


def test_records_are_decoded_in_slices():
    """A worker hands on a few records at a time, and the text of decoded ones not at all."""
    import pyarrow as pa
    good, bad = "<article><front></front></article>", "<article><front>"
    texts = [bad if i % 100 == 7 else good for i in range(1000)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1001)), pa.array(texts), pa.array(["x"] * 1001)],
                                       names=["offset", "article_xml", "file"])
    out = list(decoded_slices([batch], 1))
    assert max(b.num_rows for b in out) <= 128 and sum(b.num_rows for b in out) == 1001
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["offset"] for r in rows] == list(range(1001)) and rows[5]["file"] == "x"
    assert [r["offset"] for r in rows if r["article_xml"]] == list(range(7, 1000, 100))
    assert rows[7]["a"]["error"] == "truncated" and rows[1000]["a"]["error"] == "malformed" and rows[0]["a"]["ok"]
