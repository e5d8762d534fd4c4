from cohortlab.streaming.evaluate import (auroc_now, keep_score_counts, read_parquet_stream, running_confusion,
                                          score_stream, start)

__all__ = ["auroc_now", "keep_score_counts", "read_parquet_stream", "running_confusion", "score_stream", "start"]
