"""Report datasets and the nightly batch, composed from the operators."""
