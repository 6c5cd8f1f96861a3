"""Event-log change analytics and corpus preparation as Spark plans."""
