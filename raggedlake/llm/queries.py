"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from pyspark.sql import DataFrame, SparkSession

from raggedlake.llm import oracle
from raggedlake.llm.byte_bpe import op6_byte_bpe
from raggedlake.llm.license_scan import op1_license_scan
from raggedlake.llm.ngram_join import op5_ngram_join
from raggedlake.llm.packing import op7_packing
from raggedlake.llm.quality_classifier import op2_quality_classifier
from raggedlake.llm.quality_rules import op4_quality_rules
from raggedlake.llm.suffix_dedup import op9_suffix_dedup
from raggedlake.llm.token_counts import op10_token_counts
from raggedlake.llm.toxicity import op8_toxicity
from raggedlake.llm.vector_index import op3_vector_index


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_license_scan": op1_license_scan,
    "op3_vector_index": op3_vector_index,
    "op2_quality_classifier": op2_quality_classifier,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_join": op5_ngram_join,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_packing": op7_packing,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_counts": op10_token_counts,
}
#: The others have no SQL form that finishes on whole tables; tests hold them against brute force and libraries.
ORACLE_SQL: dict[str, str] = {"op4_quality_rules": oracle.quality_rules()}
