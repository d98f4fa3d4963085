"""turnwise: context evaluation for chat conversations, written as Spark DataFrame jobs."""
