"""Analytics for packets seen by network telescopes, as Spark DataFrame operators."""
