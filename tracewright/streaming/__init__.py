"""Sample-at-a-time forms: the same steps as in operators.scans, with the state kept between triggers."""
