"""Fixed schemas of pages, blocks and fragments, and the tunable constants."""

from __future__ import annotations

from dataclasses import dataclass

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"
SPAN = "struct<text:string,size:double,font:string,flags:int,bbox:array<double>>"
LINE = f"struct<spans:array<{SPAN}>>"
RAW_BLOCK = f"struct<type:int,bbox:array<double>,lines:array<{LINE}>>"
BOX = "struct<x0:double,x1:double,y0:double,y1:double,text:string>"
LINK = f"struct<rect:{RECT},kind:int,uri:string,page:int>"
RAW_TABLE = f"struct<bbox:{RECT},rows:array<array<string>>>"
DETECTION = "struct<poly:array<array<double>>,text:string,conf:double>"
RAW_PAGE = (
    f"doc_id long, page_number int, width double, height double, blocks array<{RAW_BLOCK}>, drawings array<{RECT}>, "
    f"links array<{LINK}>, raw_tables array<{RAW_TABLE}>, ocr array<{DETECTION}>"
)
RUN = "struct<text:string,bold:boolean,italic:boolean,superscript:boolean,href:string>"
BLOCK = (
    f"struct<type:string,text:string,level:int,ordered:boolean,runs:array<{RUN}>,rows:array<array<string>>,"
    "src:string,alt:string,caption:string,column:int,indent_em:double>"
)
FRAGMENT = f"doc_id long, page_number int, margin array<string>, blocks array<{BLOCK}>, callout array<string>"
BOOK = "id long, title string, authors array<struct<name:string,birth_year:int,death_year:int>>, subjects array<string>, bookshelves array<string>, languages array<string>, download_count long, copyright boolean, formats map<string,string>"

#: Kinds of a link on a page.
LINK_GOTO, LINK_URI = 1, 2
#: Bits of a span's flags.
SUPERSCRIPT, ITALIC, BOLD = 1, 2, 16


@dataclass(frozen=True)
class Limits:
    """Thresholds of extraction and audit. Points on the text path, pixels at 300 dpi on the OCR path."""

    garbled_share: float = 0.2
    garbled_length: int = 20
    margin_share: float = 0.09
    margin_length: int = 70
    numeric_share: float = 0.6
    numeric_chars: int = 4
    row_overlap: float = 0.5
    paragraph_gap: float = 1.3
    split_gap_px: float = 100.0
    split_gap_ratio: float = 3.0
    column_gap_pt: float = 24.0
    sibling_share: float = 0.5
    callout_width: float = 0.85
    callout_size: float = 20.0
    callout_image: float = 0.5
    covered: float = 0.5
    title_width: float = 0.6
    table_size: int = 2
    heading_h3: float = 1.15
    heading_h2: float = 1.35
    heading_bold: float = 0.8
    heading_tolerance: float = 0.05
    heading_length: int = 120
    body_chars: int = 200
    ocr_heading_h3: float = 1.25
    ocr_heading_h2: float = 1.5
    ocr_heading_length: int = 80
    ocr_continued_height: float = 0.9
    ocr_continued_gap: float = 0.5
    px_per_em: float = 300 / 72 * 11
    indent_least: float = 0.3
    indent_most: float = 4.0
    touch_pt: float = 3.0
    coverage: float = 0.85
    order: float = 0.85
    order_matched: int = 8
    margin_words: int = 12


LIMITS = Limits()
#: Characters that end a paragraph, list bullets, monospace font names, labels of notes and listings.
TERMINATORS = ".!?:;»)”"
BULLETS = "►•‣▪●○◦"
MONOSPACE = ("courier", "consolas", "mono", "menlo", "cascadia", "roboto mono")
NOTE_LABELS = ("ПРИМЕЧАНИЕ", "ВНИМАНИЕ", "СОВЕТ")
LISTING_LABELS = ("Лістинг", "Листинг")
IMAGE_LABEL = "Изображение"
