"""Fixed lookup tables of provider names, and the columns built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.functions.columns import local_table

# Provider service name -> service category.
AWS_CATEGORIES = {
    "Amazon Elastic Compute Cloud": "Compute",
    "Amazon Relational Database Service": "Database",
    "Amazon Simple Storage Service": "Storage",
    "Amazon CloudFront": "Networking",
    "AWS Lambda": "Compute",
    "Amazon Elastic Kubernetes Service": "Compute",
    "Amazon DynamoDB": "Database",
    "Amazon ElastiCache": "Database",
    "Amazon Virtual Private Cloud": "Networking",
    "Amazon Route 53": "Networking",
    "AWS Key Management Service": "Security",
    "Amazon SageMaker": "AI/ML",
    "Amazon Bedrock": "AI/ML",
}
AZURE_CATEGORIES = {
    "Virtual Machines": "Compute",
    "Storage": "Storage",
    "SQL Database": "Database",
    "Azure Kubernetes Service": "Compute",
    "Azure Functions": "Compute",
    "Azure Cosmos DB": "Database",
    "Azure Cache for Redis": "Database",
    "Virtual Network": "Networking",
    "Azure DNS": "Networking",
    "Azure OpenAI": "AI/ML",
    "Azure Machine Learning": "AI/ML",
}
GCP_CATEGORIES = {
    "Compute Engine": "Compute",
    "Cloud Storage": "Storage",
    "Cloud SQL": "Database",
    "Google Kubernetes Engine": "Compute",
    "Cloud Functions": "Compute",
    "Cloud Run": "Compute",
    "BigQuery": "Analytics",
    "Cloud Spanner": "Database",
    "Cloud Bigtable": "Database",
    "Cloud Pub/Sub": "Integration",
    "Vertex AI": "AI/ML",
    "Gemini": "AI/ML",
    "Cloud Networking": "Networking",
}

# Provider service name -> normalised service name.
AWS_SERVICES = {
    "Amazon Elastic Compute Cloud - Compute": "Virtual Machine",
    "Amazon Simple Storage Service": "Object Storage",
    "Amazon Relational Database Service": "Relational Database",
    "AmazonCloudWatch": "Monitoring",
    "AWS Lambda": "Serverless Function",
    "Amazon EC2 Container Service": "Container Orchestration",
    "Amazon Elastic Kubernetes Service": "Container Orchestration",
    "Amazon CloudFront": "CDN",
    "Amazon Route 53": "DNS",
    "AWS Key Management Service": "Key Management",
}
AZURE_SERVICES = {
    "Virtual Machines": "Virtual Machine",
    "Storage": "Object Storage",
    "SQL Database": "Relational Database",
    "Azure Database for PostgreSQL": "Relational Database",
    "Azure Functions": "Serverless Function",
    "Azure Kubernetes Service": "Container Orchestration",
    "Bandwidth": "Networking",
    "Azure DNS": "DNS",
}
GCP_SERVICES = {
    "Compute Engine": "Virtual Machine",
    "Cloud Storage": "Object Storage",
    "Cloud SQL": "Relational Database",
    "Cloud Functions": "Serverless Function",
    "Google Kubernetes Engine": "Container Orchestration",
    "Cloud DNS": "DNS",
    "Cloud CDN": "CDN",
    "Cloud Load Balancing": "Load Balancer",
}

# AWS region code -> region name.
AWS_REGIONS = {
    "us-east-1": "US East (N. Virginia)",
    "us-west-2": "US West (Oregon)",
    "eu-west-1": "EU (Ireland)",
    "ap-southeast-1": "Asia Pacific (Singapore)",
}

# Normalised AWS service names per category.
AWS_COMPUTE = ["Virtual Machine", "Serverless Function", "Container Orchestration"]
AWS_STORAGE = ["Object Storage", "Block Storage", "File Storage", "Backup"]
AWS_DATABASE = ["Relational Database", "NoSQL Database", "Cache", "Data Warehouse"]
AWS_NETWORK = ["CDN", "DNS", "Load Balancer", "VPN"]

# Publisher per provider.
PUBLISHERS = {
    "aws": "Amazon Web Services",
    "azure": "Microsoft Azure",
    "gcp": "Google Cloud",
}


def category_dim(spark: SparkSession) -> DataFrame:
    rows = [
        (provider, name, category)
        for provider, table in (("aws", AWS_CATEGORIES), ("azure", AZURE_CATEGORIES), ("gcp", GCP_CATEGORIES))
        for name, category in table.items()
    ]
    return local_table(spark, ["provider_name", "service_name", "service_category"], rows)


def service_dim(spark: SparkSession) -> DataFrame:
    rows = [
        (provider, raw, name)
        for provider, table in (("aws", AWS_SERVICES), ("azure", AZURE_SERVICES), ("gcp", GCP_SERVICES))
        for raw, name in table.items()
    ]
    return local_table(spark, ["provider_name", "source_service", "service_name"], rows)


def infer_category(provider: str, service: str) -> Column:
    """Category of a normalised service name: by set for AWS, by substring elsewhere."""
    p, s = F.col(provider), F.col(service)
    aws = (
        F.when(s.isin(AWS_COMPUTE), "Compute")
        .when(s.isin(AWS_STORAGE), "Storage")
        .when(s.isin(AWS_DATABASE), "Database")
        .when(s.isin(AWS_NETWORK), "Networking")
        .otherwise("Other")
    )
    others = (
        F.when(s.contains("Virtual Machine"), "Compute")
        .when(s.contains("Storage"), "Storage")
        .when(s.contains("Database"), "Database")
        .when((p == "gcp") & (s.contains("CDN") | s.contains("DNS") | s.contains("Load Balancer")), "Networking")
        .otherwise("Other")
    )
    return F.when(p == "aws", aws).otherwise(others)
