"""The queries of this package, and SQL for those that SQL can express."""

from . import clustering, decontamination, embeddings, minhash, variants
from .bpe import op5_bpe
from .clustering import op12_centroids
from .decontamination import op10_decontamination
from .embeddings import op3_near_vectors
from .html import op8_html
from .linededup import op1_line_dedup
from .minhash import op2_near_duplicates
from .mixing import op11_mix
from .pii import op4_personal_data
from .secrets import op9_secrets
from .sharding import op6_sharding
from .toxicity import op7_toxicity
from .variants import op13_variants

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_near_vectors": op3_near_vectors,
    "op4_personal_data": op4_personal_data,
    "op5_bpe": op5_bpe,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_html": op8_html,
    "op9_secrets": op9_secrets,
    "op10_decontamination": op10_decontamination,
    "op11_mix": op11_mix,
    "op12_centroids": op12_centroids,
    "op13_variants": op13_variants,
}

SQL: dict[str, str] = {"op2_near_duplicates": minhash.SQL, "op3_near_vectors": embeddings.SQL, "op10_decontamination": decontamination.SQL, "op12_centroids": clustering.SQL, "op13_variants": variants.SQL}
