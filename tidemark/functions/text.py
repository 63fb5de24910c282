"""Text columns: images, embedding texts, query texts, cuts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SNIPPET, PROMPT, QUOTE, FIX, EMBED = 200, 1600, 140, 400, 1600
#: Markdown, shortcode and HTML image references, in this order.
IMAGE_REFS = (r"!\[[^\]]*\]\(([^)\s]+)", r'\{\{<\s*figure\b[^>]*src="([^"]+)"', r"""<img\b[^>]*src=["']([^"']+)["']""")
#: What shows that a ticket holds an image.
TICKET_IMAGES = (r"!\[[^\]]*\]\(", r"user-images\.githubusercontent\.com/", r"github\.com/user-attachments/", r"<img\b")
#: Addresses of ticket images.
IMAGE_URLS = (r"(?U)!\[[^\]]*\]\((https?://[^\s)]+)\)", r"""(?iU)<img\b[^>]*?src=["'](https?://[^"']+)["']""", r"""(?U)(https://(?:user-images\.githubusercontent\.com|github\.com/user-attachments/assets)[^\s)"'<>\]]+)""")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _all(patterns: tuple[str, ...], c: Column) -> Column:
    return F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in patterns))


def image_refs(raw: Column) -> Column:
    """Image references of a page source, in pattern order, repeats kept."""
    return _all(IMAGE_REFS, F.coalesce(raw, F.lit("")))


def has_images(body: Column) -> Column:
    return F.coalesce(body.rlike("|".join(TICKET_IMAGES)), F.lit(False))


def image_urls(body: Column, most: int = 3) -> Column:
    """The first few different image addresses of a ticket."""
    return F.slice(F.array_distinct(_all(IMAGE_URLS, F.coalesce(body, F.lit("")))), 1, most)


def without_fences(body: Column) -> Column:
    return F.regexp_replace(F.coalesce(body, F.lit("")), r"(?s)```.*?```", " ")


def embed_text(title: Column, body: Column, most: int = EMBED) -> Column:
    return F.substring(strip(F.concat(title, F.lit("\n\n"), without_fences(body))), 1, most)


def captioned_embed_text(title: Column, body: Column, captions: Column) -> Column:
    """Title, captions and body with budgets of 200, 400 and 1200 characters; empty parts vanish."""
    shown = F.when(F.coalesce(captions, F.lit("")) != "", F.concat(F.lit("Image content: "), F.substring(captions, 1, 400))).otherwise("")
    parts = F.array(F.substring(title, 1, 200), shown, F.substring(without_fences(body), 1, 1200))
    return strip(F.array_join(F.filter(parts, lambda p: p != ""), "\n\n"))


def query_text(title: Column, body: Column) -> Column:
    return F.concat(title, F.lit("\n"), F.substring(F.coalesce(body, F.lit("")), 1, 500))
