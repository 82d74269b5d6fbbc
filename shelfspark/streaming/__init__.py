from shelfspark.streaming.incremental import daily_store_gmv, feed_stream, start_fact_loader

__all__ = ["daily_store_gmv", "feed_stream", "start_fact_loader"]
