"""Citations: numbers by first use, and how they read."""

from __future__ import annotations

FIELDS = ("chunk_id", "document_id", "document_version", "source_type", "source_date", "article_number", "article_title", "opinion_author", "division", "page_start", "page_end", "page_label_start", "page_label_end", "source_url")


def build_citation(number: int, item: dict) -> dict:
    return {"citation_id": number, "evidence_id": item["evidence_id"], "title": item["document_title"]} | {k: item.get(k) for k in FIELDS}


def source_label(c: dict, show_author: bool = False) -> str:
    """What kind of text is quoted."""
    kind = c["source_type"]
    if kind == "constitutional_text":
        if not c["article_number"]:
            return "constitutional text"
        return f"Article {c['article_number']}" + (f" ({c['article_title']})" if c["article_title"] else "")
    if kind == "user_document":
        return "uploaded document"
    if c["division"] == "front_matter":
        return "reporter's headnote"
    return f"opinion of {c['opinion_author']}" if show_author and c["opinion_author"] else "judgment text"


def _span(one: str, many: str, first, last) -> str:
    return f"{one} {first}" if first == last else f"{many} {first}–{last}"


def format_pages(c: dict) -> str:
    pdf = _span("PDF p.", "PDF pp.", c["page_start"], c["page_end"])
    if not c["page_label_start"]:
        return pdf
    same = c["page_label_start"] == c["page_label_end"]
    return f"printed p. {c['page_label_start']}{'' if same else '–' + str(c['page_label_end'])} ({pdf})"


def format_date(d) -> str:
    return f"{d.day} {d:%B %Y}"


def format_citation(c: dict, show_author: bool = False, label: str | None = None) -> str:
    label = label or f"[{c['citation_id']}]"
    if c["source_type"] == "user_document":
        return f"{label} {c['title']} — {_span('Page', 'Pages', c['page_start'], c['page_end'])}"
    dated = f" ({format_date(c['source_date'])})" if c["source_type"] == "judgment" and c["source_date"] else ""
    return f"{label} {c['title']}{dated}, {source_label(c, show_author)}, {format_pages(c)}"


class CitationNumbers:
    """One number for each evidence item, in order of first use."""

    def __init__(self) -> None:
        self.citations: list[dict] = []
        self._numbers: dict[str, int] = {}

    def cite(self, item: dict) -> dict:
        n = self._numbers.setdefault(item["evidence_id"], len(self.citations) + 1)
        if n > len(self.citations):
            self.citations.append(build_citation(n, item))
        return self.citations[n - 1]
