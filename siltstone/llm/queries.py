"""The queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from .ann import op9_ann
from .decontam import OP4_SQL, op4_decontamination
from .langid import op8_language_id
from .mixing import OP2_SQL, op2_source_mixing
from .pii import op6_pii_surrogates
from .quality import op5_quality
from .secrets import OP10_SQL, op10_secret_scan
from .simhash import op3_simhash
from .substrings import op7_repeated_substrings
from .warc import OP1_SQL, op1_warc_bundles

QUERIES = {
    "op1_warc_bundles": op1_warc_bundles,
    "op10_secret_scan": op10_secret_scan,
    "op2_source_mixing": op2_source_mixing,
    "op3_simhash": op3_simhash,
    "op4_decontamination": op4_decontamination,
    "op5_quality": op5_quality,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_repeated_substrings": op7_repeated_substrings,
    "op8_language_id": op8_language_id,
    "op9_ann": op9_ann,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_bundles": OP1_SQL,
    "op10_secret_scan": OP10_SQL,
    "op2_source_mixing": OP2_SQL,
    "op4_decontamination": OP4_SQL,
}
