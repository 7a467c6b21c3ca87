"""Sources: embedding providers, their HTTP calls, and the files of asynchronous jobs."""
