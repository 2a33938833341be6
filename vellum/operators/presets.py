"""The presets: what each publisher's format states, and what every format has unless it says otherwise."""

#: The settings of every format unless it says otherwise; margins are top, bottom, left, right.
DEFAULT = {
    "name": "Generic",
    "page": {
        "size": "A4", "columns": 1, "line_numbers": False, "margins_cm": [2.54, 2.54, 2.54, 2.54], "col_gap_cm": 0.5,
        "front_matter_single_column": True, "page_numbers": True,
    },
    "font": {
        "family": "Times New Roman", "size": 12.0, "line_spacing": 1.5, "align": "justify", "first_line_indent_cm": 0.0, "space_before_pt": 0,
        "space_after_pt": 6,
    },
    "title": {"size": 16, "bold": True, "italic": False, "align": "center", "case": "as-is", "space_after_pt": 12},
    "authors": {"size": 11, "bold": False, "italic": False, "align": "center"},
    "affiliation": {"size": 10, "bold": False, "italic": True, "align": "center"},
    "abstract": {
        "layout": "block", "structured": False, "heading": "Abstract", "suffix": ": ", "size": 11, "label_bold": True, "label_italic": False,
        "body_bold": False, "body_italic": False, "align": "justify", "indent_cm": 0.0,
    },
    "keywords": {
        "label": "Keywords", "separator": "; ", "case": "as-is", "suffix": ": ", "size": 11, "label_bold": True, "label_italic": False,
        "body_italic": False, "end_period": False,
    },
    "headings": {
        "scheme": "decimal", "decimal_trailing_dot": True, "subsection_trailing_dot": True,
        "levels": [
            {"size": 12, "bold": True, "italic": False, "case": "as-is", "align": "left", "smallcaps": False, "space_before_pt": 12, "space_after_pt": 6},
            {"size": 12, "bold": True, "italic": False, "case": "as-is", "align": "left", "smallcaps": False, "space_before_pt": 10, "space_after_pt": 4},
            {"size": 12, "bold": True, "italic": True, "case": "as-is", "align": "left", "smallcaps": False, "space_before_pt": 8, "space_after_pt": 4},
            {"size": 12, "bold": False, "italic": True, "case": "as-is", "align": "left", "smallcaps": False, "space_before_pt": 6, "space_after_pt": 2},
        ],
    },
    "captions": {
        "figure_label": "Figure", "table_numbering": "arabic", "separator": ". ", "end_period": True, "table_label": "Table",
        "table_label_case": "as-is", "label_bold": True, "label_italic": False, "size": 10, "align": "center", "table_position": "above",
        "table_label_newline": False, "body_italic": False,
    },
    "tables": {"size": 10, "borders": "booktabs", "header_bold": True},
    "references": {"style": "apa", "heading": "References", "size": 11, "hanging_indent_cm": 1.27},
    "citations": {"mode": "author-year"},
    "body_xref": {"figure": "Figure", "table": "Table"},
    "latex": {"class": "article", "options": "11pt,a4paper", "bibstyle": ""},
    "limits": {"abstract_words": None, "keywords_min": None, "keywords_max": None, "title_words": None, "total_words": None},
    "required_sections": [],
}

#: What each preset states; base names the preset that it builds on.
PRESETS = {
    "ieee_journal": {
        "name": "IEEE Transactions / Journals (incl. IEEE Access)",
        "page": {"size": "Letter", "columns": 2, "margins_cm": [1.9, 2.54, 1.57, 1.57], "col_gap_cm": 0.43},
        "font": {"size": 10.0, "line_spacing": 1.0, "first_line_indent_cm": 0.36, "space_after_pt": 0},
        "title": {"size": 24, "bold": False, "case": "title"},
        "affiliation": {"size": 8, "italic": False},
        "abstract": {"layout": "inline", "suffix": "—", "size": 9, "label_italic": True, "body_bold": True},
        "keywords": {"label": "Index Terms", "separator": ", ", "case": "lower-first", "suffix": "—", "size": 9, "label_italic": True, "end_period": True},
        "headings": {
            "scheme": "ieee",
            "levels": [
                {"size": 10, "bold": False, "italic": False, "case": "title", "align": "center", "smallcaps": True},
                {"size": 10, "bold": False, "italic": True, "case": "title", "align": "left"},
                {"size": 10, "bold": False, "italic": True, "case": "sentence", "align": "left"},
                {"size": 10, "bold": False, "italic": True, "case": "sentence", "align": "left"},
            ],
        },
        "captions": {
            "figure_label": "Fig.", "table_numbering": "roman", "table_label_case": "upper", "label_bold": False, "size": 8,
            "table_label_newline": True, "table_caption_case": "upper", "table_end_period": False,
        },
        "tables": {"size": 8},
        "references": {"style": "ieee", "size": 8, "hanging_indent_cm": 0.63},
        "citations": {"mode": "numeric"},
        "body_xref": {"figure": "Fig."},
        "latex": {"class": "IEEEtran", "options": "journal", "bibstyle": "IEEEtran"},
        "limits": {"abstract_words": 250, "keywords_min": 3, "keywords_max": 10},
    },
    "ieee_conference": {
        "name": "IEEE Conference",
        "page": {"size": "Letter", "columns": 2, "margins_cm": [1.9, 2.54, 1.78, 1.78], "col_gap_cm": 0.64},
        "font": {"size": 10.0, "line_spacing": 1.0, "first_line_indent_cm": 0.36, "space_after_pt": 0},
        "title": {"size": 24, "bold": False, "case": "title"},
        "affiliation": {"size": 10},
        "abstract": {"layout": "inline", "suffix": "—", "size": 9, "label_italic": True, "body_bold": True},
        "keywords": {"label": "Index Terms", "separator": ", ", "case": "lower-first", "suffix": "—", "size": 9, "label_italic": True, "body_bold": True},
        "headings": {
            "scheme": "ieee",
            "levels": [
                {"size": 10, "bold": False, "italic": False, "case": "title", "align": "center", "smallcaps": True},
                {"size": 10, "bold": False, "italic": True, "case": "title", "align": "left"},
                {"size": 10, "bold": False, "italic": True, "case": "sentence", "align": "left"},
                {"size": 10, "bold": False, "italic": True, "case": "sentence", "align": "left"},
            ],
        },
        "captions": {
            "figure_label": "Fig.", "table_numbering": "roman", "table_label_case": "upper", "label_bold": False, "size": 8,
            "table_label_newline": True, "table_caption_case": "upper", "table_end_period": False,
        },
        "tables": {"size": 8},
        "references": {"style": "ieee", "size": 8, "hanging_indent_cm": 0.63},
        "citations": {"mode": "numeric"},
        "body_xref": {"figure": "Fig."},
        "latex": {"class": "IEEEtran", "options": "conference", "bibstyle": "IEEEtran"},
        "limits": {"abstract_words": 200},
    },
    "elsevier": {
        "name": "Elsevier (elsarticle, numbered references)",
        "page": {"line_numbers": True, "margins_cm": [2.5, 2.5, 2.5, 2.5]},
        "font": {"line_spacing": 2.0},
        "title": {"size": 17, "bold": False},
        "headings": {
            "levels": [
                {"size": 12, "bold": True},
                {"size": 12, "bold": False, "italic": True},
                {"size": 12, "bold": False, "italic": True},
                {"size": 12, "bold": False, "italic": True},
            ],
        },
        "captions": {"figure_label": "Fig."},
        "references": {"style": "elsevier-numeric", "hanging_indent_cm": 0.75},
        "citations": {"mode": "numeric"},
        "body_xref": {"figure": "Fig."},
        "latex": {"class": "elsarticle", "options": "preprint,12pt", "bibstyle": "elsarticle-num"},
        "limits": {"abstract_words": 250, "keywords_min": 1, "keywords_max": 7},
    },
    "elsevier_harvard": {
        "base": "elsevier",
        "name": "Elsevier (author–year / Harvard)",
        "references": {"style": "harvard"},
        "citations": {"mode": "author-year"},
        "latex": {"bibstyle": "elsarticle-harv"},
    },
    "springer_journal": {
        "name": "Springer Nature journals (sn-jnl)",
        "page": {"margins_cm": [2.5, 2.5, 2.5, 2.5]},
        "font": {"size": 11.0},
        "abstract": {"size": 10},
        "keywords": {"separator": " · ", "suffix": " ", "size": 10},
        "headings": {
            "decimal_trailing_dot": False, "subsection_trailing_dot": False,
            "levels": [
                {"size": 12, "bold": True},
                {"size": 11, "bold": True},
                {"size": 11, "bold": False, "italic": True},
                {"size": 11, "bold": False, "italic": True},
            ],
        },
        "captions": {"figure_label": "Fig.", "separator": " ", "end_period": False, "size": 9},
        "references": {"style": "springer-basic", "size": 10},
        "citations": {"mode": "author-year-nocomma"},
        "body_xref": {"figure": "Fig."},
        "latex": {
            "bibstyle": "spbasic",
            "note": "Springer's sn-jnl class is not installed on Overleaf by default; this export uses article with Springer layout. To switch, add sn-jnl.cls from the Springer Nature LaTeX template.",
        },
        "limits": {"abstract_words": 250, "keywords_min": 4, "keywords_max": 6},
    },
    "springer_numeric": {
        "base": "springer_journal",
        "name": "Springer Nature journals (numbered references)",
        "references": {"style": "springer-vancouver"},
        "citations": {"mode": "numeric"},
        "latex": {"bibstyle": "spmpsci"},
    },
    "springer_lncs": {
        "name": "Springer LNCS / conference proceedings",
        "page": {"margins_cm": [5.25, 5.25, 4.4, 4.4]},
        "font": {"size": 10.0, "line_spacing": 1.0, "first_line_indent_cm": 0.42, "space_after_pt": 0},
        "title": {"size": 14},
        "authors": {"size": 10},
        "affiliation": {"size": 9, "italic": False},
        "abstract": {"layout": "inline", "suffix": ". ", "size": 9},
        "keywords": {"separator": " · ", "size": 9},
        "headings": {
            "decimal_trailing_dot": False, "subsection_trailing_dot": False,
            "levels": [
                {"size": 12, "bold": True},
                {"size": 10, "bold": True},
                {"size": 10, "bold": True},
                {"size": 10, "bold": False, "italic": True},
            ],
        },
        "captions": {"figure_label": "Fig.", "size": 9},
        "tables": {"size": 9},
        "references": {"style": "lncs", "size": 9, "hanging_indent_cm": 0.5},
        "citations": {"mode": "numeric"},
        "body_xref": {"figure": "Fig."},
        "latex": {"class": "llncs", "options": "runningheads", "bibstyle": "splncs04"},
        "limits": {"abstract_words": 250, "keywords_min": 3, "keywords_max": 6},
    },
    "mdpi": {
        "name": "MDPI journals",
        "page": {"margins_cm": [2.5, 2.5, 2.0, 2.0]},
        "font": {"family": "Palatino Linotype", "size": 10.0, "line_spacing": 1.0, "first_line_indent_cm": 0.75, "space_after_pt": 0},
        "title": {"size": 18, "align": "left"},
        "authors": {"size": 10, "bold": True, "align": "left"},
        "affiliation": {"size": 8, "italic": False, "align": "left"},
        "abstract": {"layout": "inline", "size": 9},
        "keywords": {"size": 9},
        "headings": {
            "levels": [
                {"size": 10, "bold": True},
                {"size": 10, "bold": False, "italic": True},
                {"size": 10, "bold": False, "italic": False},
                {"size": 10, "bold": False, "italic": True},
            ],
        },
        "captions": {"size": 9, "align": "left"},
        "tables": {"size": 9},
        "references": {"style": "mdpi", "size": 9, "hanging_indent_cm": 0.6},
        "citations": {"mode": "numeric"},
        "latex": {"options": "10pt,a4paper", "bibstyle": "mdpi"},
        "limits": {"abstract_words": 200, "keywords_min": 3, "keywords_max": 10},
    },
    "emerald": {
        "name": "Emerald journals (structured abstract, Harvard)",
        "font": {"line_spacing": 2.0},
        "abstract": {"structured": True, "size": 12},
        "keywords": {"separator": ", ", "case": "title", "suffix": " ", "size": 12},
        "headings": {
            "subsection_trailing_dot": False,
            "levels": [
                {"size": 12, "bold": True},
                {"size": 12, "bold": True, "italic": True},
                {"size": 12, "bold": False, "italic": True},
                {"size": 12, "bold": False, "italic": True},
            ],
        },
        "captions": {"end_period": False, "size": 11},
        "references": {"style": "emerald-harvard", "size": 12},
        "latex": {"options": "12pt,a4paper"},
        "limits": {"abstract_words": 250, "keywords_max": 12, "title_words": 15},
    },
    "taylor_francis": {
        "name": "Taylor & Francis (APA style)",
        "font": {"line_spacing": 2.0},
        "abstract": {"size": 12},
        "keywords": {"size": 12},
        "headings": {
            "subsection_trailing_dot": False,
            "levels": [
                {"size": 12, "bold": True},
                {"size": 12, "bold": True, "italic": True},
                {"size": 12, "bold": False, "italic": True},
                {"size": 12, "bold": False, "italic": True},
            ],
        },
        "captions": {"label_bold": False, "size": 11},
        "references": {"size": 12},
        "latex": {"options": "12pt,a4paper"},
        "limits": {"abstract_words": 200, "keywords_min": 3, "keywords_max": 6},
    },
    "wiley": {
        "base": "taylor_francis",
        "name": "Wiley journals (generic, APA)",
    },
    "apa7": {
        "name": "APA 7th edition (theses, APA journals)",
        "page": {"size": "Letter"},
        "font": {"line_spacing": 2.0, "align": "left", "first_line_indent_cm": 1.27, "space_after_pt": 0},
        "title": {"size": 12, "case": "title"},
        "authors": {"size": 12},
        "affiliation": {"size": 12, "italic": False},
        "abstract": {"size": 12, "align": "left"},
        "keywords": {"separator": ", ", "size": 12, "label_bold": False, "label_italic": True},
        "headings": {
            "scheme": "none",
            "levels": [
                {"size": 12, "bold": True, "case": "title", "align": "center"},
                {"size": 12, "bold": True, "case": "title", "align": "left"},
                {"size": 12, "bold": True, "italic": True, "case": "title", "align": "left"},
                {"size": 12, "bold": True, "case": "title", "align": "left"},
            ],
        },
        "captions": {"separator": "\n", "end_period": False, "size": 12, "align": "left", "body_italic": True, "figure_position": "above"},
        "references": {"size": 12},
        "latex": {"options": "12pt,letterpaper"},
        "limits": {"abstract_words": 250, "keywords_min": 3, "keywords_max": 5},
    },
    "plos": {
        "name": "PLOS (Vancouver)",
        "page": {"size": "Letter", "line_numbers": True},
        "font": {"family": "Arial", "size": 10.0, "align": "left"},
        "title": {"size": 18, "align": "left"},
        "abstract": {"size": 10},
        "headings": {
            "scheme": "none",
            "levels": [
                {"size": 14, "bold": True},
                {"size": 12, "bold": True},
                {"size": 10, "bold": True},
                {"size": 10, "bold": False, "italic": True},
            ],
        },
        "captions": {"figure_label": "Fig", "align": "left"},
        "references": {"style": "vancouver", "size": 10, "hanging_indent_cm": 0.63},
        "citations": {"mode": "numeric"},
        "body_xref": {"figure": "Fig"},
        "latex": {"options": "10pt,letterpaper"},
        "limits": {"abstract_words": 300},
    },
    "frontiers": {
        "name": "Frontiers journals",
        "font": {"line_spacing": 1.15},
        "abstract": {"size": 12},
        "keywords": {"separator": ", "},
        "headings": {
            "decimal_trailing_dot": False, "subsection_trailing_dot": False,
            "levels": [
                {"bold": True, "case": "upper"},
                {"bold": True},
                {"bold": True, "italic": True},
                {"bold": False, "italic": True},
            ],
        },
        "captions": {"separator": " "},
        "references": {"style": "harvard", "size": 12},
        "limits": {"abstract_words": 350, "keywords_min": 5, "keywords_max": 8},
    },
    "generic_numeric": {
        "name": "Generic numbered (Vancouver)",
        "references": {"style": "vancouver"},
        "citations": {"mode": "numeric"},
    },
}
