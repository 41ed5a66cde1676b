"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from folio.llm.alignment import op11_alignment
from folio.llm.conversations import op13_conversations
from folio.llm.jaccard import OP4_SQL, op4_jaccard
from folio.llm.language import op10_language
from folio.llm.media import op6_media
from folio.llm.mixing import OP1_SQL, op1_mixing
from folio.llm.neighbours import op5_neighbours
from folio.llm.packing import op2_packing
from folio.llm.personal import op7_personal
from folio.llm.repeats import op3_repeats
from folio.llm.sharding import op8_sharding
from folio.llm.toxicity import op9_toxicity
from folio.llm.urls import OP12_SQL, op12_urls

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_repeats": op3_repeats,
    "op4_jaccard": op4_jaccard,
    "op5_neighbours": op5_neighbours,
    "op6_media": op6_media,
    "op7_personal": op7_personal,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
    "op11_alignment": op11_alignment,
    "op12_urls": op12_urls,
    "op13_conversations": op13_conversations,
}
SQL = {"op1_mixing": OP1_SQL, "op4_jaccard": OP4_SQL, "op12_urls": OP12_SQL}
