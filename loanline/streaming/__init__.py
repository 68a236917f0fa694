from loanline.streaming.ingest import ingest_stream, new_against_fixed
from loanline.streaming.scoring import score_stream, score_stream_measured, stream_metrics

__all__ = ["ingest_stream", "new_against_fixed", "score_stream", "score_stream_measured", "stream_metrics"]
