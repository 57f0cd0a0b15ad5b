"""loomlake: relationship, event and corpus analytics expressed as Spark plans."""
