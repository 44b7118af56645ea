"""All registered queries of the subpackage: importing the modules registers them."""

from tidemark.llm import fingerprint, idcoder, licenses, linededup, packing, pii, quality, repair, simhash, spm, toxicity, warc, whitening  # noqa: F401
from tidemark.llm.common import QUERIES, SQL  # noqa: F401
