"""Column builders. All of them are stateless, so they also work on a stream."""
